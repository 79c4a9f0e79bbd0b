import hashlib
import random
from collections import Counter

import pytest
from test_text import words_of

from shopwake.llm import decontamination
from shopwake.llm.decontamination import benchmark_hits, contaminated, n_hit
from shopwake.llm.suffix_dedup import repeated_bytes


def hits_by_hand(texts, items, window):
    own = [(i, w, min(len(w), window)) for i, w in ((i, words_of(t)) for i, t in items) if w]
    wanted = [(i, tuple(w[k : k + n])) for i, w, n in own for k in range(len(w) - n + 1)]
    out = []
    for t in texts:
        w, hit, found = words_of(t), set(), set()
        for item, x in wanted:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    if item is not None:
                        found.add(str(item))
        out.append((len(w), len(hit), tuple(sorted(found))))
    return out


@pytest.mark.parametrize("bound", [decontamination.ITEM_BYTES, 4000])
def test_benchmark_hits(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "ITEM_BYTES", bound)
    r = random.Random(8)
    words = ["Ab", "cÉ", "d", "e9", "ff", "g"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for i in range(30)] + [(3, "d d"), (3, "d d"), (77, None), (78, ""), (None, "zz yy")]
    texts = [None, "", "zz YY.", "d", " ".join(words * 30)]
    for _ in range(60):
        w = [r.choice([*words, "other"]) for _ in range(r.randint(0, 60))]
        at = r.randint(0, len(w))
        w[at:at] = (r.choice(items)[1] or "").split()[r.randint(0, 2) :]
        texts.append(r.choice([" ", ", "]).join(w).upper() if r.random() < 0.3 else " ".join(w))
    texts.append(texts[-1])
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = benchmark_hits(docs, bench, window=5)
    rows = out.select("_row.doc_id", "_row.items", "text", "n_words", n_hit().alias("n"), out["items"].alias("found"), "hits", contaminated().alias("bad")).collect()
    want = hits_by_hand(texts, items, 5)
    assert len(rows) == len(texts)
    for x in rows:
        assert (x.n_words, x.n, tuple(x.found)) == want[x.doc_id]
        assert x.bad == (x.n > 0 and 20 * x.n >= x.n_words)
        for h in x.hits:
            assert len(words_of(x.text[h.start : h.end])) == h.to_word - h.word
            assert words_of(x.text)[h.word : h.to_word] == words_of(x.text[h.start : h.end])
    assert benchmark_hits(docs.limit(0), bench).count() == 0
    assert benchmark_hits(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


@pytest.mark.parametrize("window", [1, 5])
def test_item_longer_than_a_part(spark, monkeypatch, window):
    """Cut into segments: hits across their borders stay one run, also of a very long word."""
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 2000)
    r = random.Random(9)
    long = [f"w{i}" for i in range(1500)] + ["x" * 5000, "end"]
    items = [(1, " ".join(long)), (2, "some other words of an item here"), (2, "w3 w4")]
    texts = [" ".join(["a", *long[at : at + n], "b"]) for at, n in [(0, 1502), (1490, 12), *((r.randrange(1400), r.randint(1, 90)) for _ in range(40))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"), window=window)
    rows = rows.select("_row.doc_id", "n_words", n_hit().alias("n"), "items", "hits").collect()
    want = hits_by_hand(texts, items, window)
    assert len(rows) == len(texts)
    for x in rows:
        assert (x.n_words, x.n, tuple(x["items"])) == want[x.doc_id]
        assert len(x.hits) <= 1 and (x.n < window or len(x.hits) == 1)


def repeats_by_hand(texts, size):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if times[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        yield len(b), sum(gone), len(spans), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("size", [400, 12, 3])
def test_repeated_bytes(spark, size):
    r = random.Random(size)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(0, 900))) for _ in range(20)]
    texts = [None, "", "x" * 3000, "ab" * 700, *base, *base[:2]]
    for _ in range(20):
        s = list(r.choice(base) + r.choice(base))
        for _ in range(r.randint(0, 5)):
            if s:
                s[r.randrange(len(s))] = "z"
        texts.append("".join(s))
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, base[3], "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n int")
    got = {x.doc_id: x for x in repeated_bytes(df, min_bytes=size).collect()}
    assert len(got) == len(rows)
    for (i, *_), want in zip(rows, repeats_by_hand([t for _, t, *_ in rows], size)):
        x = got[i]
        assert (x.n_bytes, sum(b - a for a, b in zip(x.lows, x.highs)), len(x.lows), x.kept_sha256) == want
    assert repeated_bytes(df.limit(0), min_bytes=size).count() == 0


def test_very_long_text(spark):
    """Longer than a buffer: a repeated passage across the pieces' border."""
    r = random.Random(1)
    long = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=4_300_000))
    at = (2 << 20) - 300
    df = spark.createDataFrame([(1, long), (2, "short " + long[at : at + 700])], "doc_id long, text string")
    got = {x.doc_id: (list(x.lows), list(x.highs)) for x in repeated_bytes(df).collect()}
    assert got == {1: ([at], [at + 700]), 2: ([6], [706])}


def test_two_benchmarks_in_the_same_workers(spark):
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "x y z") for i in range(8)], "doc_id long, text string")
    for k in range(6):
        items = spark.createDataFrame([(k, "b c" if k % 2 else "x y")], "item_id long, text string")
        hit = {r[0] for r in benchmark_hits(docs, items).where("size(items) > 0").select("_row.doc_id").collect()}
        assert hit == {i for i in range(8) if i % 2 == k % 2}
