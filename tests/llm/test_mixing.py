import math
import re
from collections import defaultdict
from hashlib import md5

import pytest

from shopwake.llm import mixing
from shopwake.llm.mixing import mix, schedule, source_order, targets, words_in
from shopwake.llm.tables import Scratch


def plan_by_hand(sizes, weights, share, repeats):
    """Targets by dealing again and again what stands above the stops."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stop = {s: repeats * n for s, n in sizes.items()}
    wanted = min(share, repeats) * sum(sizes.values())
    stopped = set()
    while True:
        free = [s for s in sizes if s not in stopped]
        rest = wanted - sum(stop[s] for s in stopped)
        target = {s: stop[s] for s in stopped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] >= stop[s]}
        if not above:
            return target
        stopped |= above


@pytest.mark.parametrize("part_rows", [mixing.PART_ROWS, 7])
def test_mix(spark, monkeypatch, part_rows):
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    rows = [(i, ["b", "a", "ä", "B", None, ""][i % 6], " ".join("w" * (1 + i % 3) for _ in range(i % 37)) + "\t\n ") for i in range(150)]
    rows += [(500, "b", None), (501, "hot", "x " * 5000), (None, "a", "p q"), (None, "a", "p q"), (7, "a", "one word two")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, target int, block int")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, s, t in rows:
        per[s] += size(t)
    want = plan_by_hand(per, (3, 1, 2), 1.5, 2)
    got = mix(df, block_words=16).collect()
    assert len(got) == len(rows)
    assert sorted((x.size for x in got)) == sorted(size(t) for _, _, t in rows)
    taken, slots = defaultdict(int), defaultdict(int)
    for x in got:
        assert x.source_size == per[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-12)
        assert 0 <= x.taken <= 2 * x.size
        assert x.taken == sum(p.to_word - p.from_word for p in x.pieces)
        taken[x.source] += x.taken
        for p in x.pieces:
            slots[p.slot] += p.to_word - p.from_word
    assert all(taken[s] == math.floor(want[s]) for s in per)
    assert max(slots.values()) <= 16 and set(slots) == set(range(len(slots)))
    again = mix(df, block_words=16).collect()
    key = lambda x: (str(x.doc_id), x.text_hash, x.taken, sorted(x.pieces))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix(df.limit(0)).count() == 0
    assert {x.taken for x in mix(df.where("text is null")).collect()} == {0}


def test_schedule_is_even(spark):
    sources = [("a", 100.0, 0), ("b", 700.0, 1), ("c", 211.0, 2)]
    plan = spark.createDataFrame(sources, "source string, target double, rank long")
    rows = schedule(plan, Scratch(spark, "t"), 1).collect()
    n = len(rows)
    assert sorted(x.slot for x in rows) == list(range(n)) and n == 1011
    for s, target, _ in sources:
        own = sorted((x.slot, x.block) for x in rows if x.source == s)
        assert [b for _, b in own] == list(range(int(target)))
        held = {k for k, _ in own}
        for end in range(50, n + 1, 50):
            assert abs(sum(k < end for k in held) - target * end / n) < 6


def test_words_match_the_pattern(spark):
    texts = ["a b", " a\x0bb\x0c ", "\x1fa", "", None, "é è"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [x.n for x in df.select(words_in(df.text).alias("n")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    ranked = source_order(spark.createDataFrame([(s,) for s in ("b", None, "B", "é", "")], "source string"), Scratch(spark, "t"))
    assert [x.source for x in ranked.orderBy("rank").collect()] == ["", "B", "b", "é", None]
    empty = spark.createDataFrame([], "source string, source_size long")
    assert targets(empty, Scratch(spark, "t")).count() == 0


def test_order_is_by_seed(spark):
    df = spark.createDataFrame([(i, "s", "a b c") for i in range(40)], "doc_id long, source string, text string")
    got = {x.doc_id: x.taken for x in mix(df, share=0.5).collect()}
    order = sorted(got, key=lambda i: md5(f"mix:{i}".encode()).hexdigest())
    assert [got[i] for i in order] == [3] * 20 + [0] * 20
