"""Operators on pairs against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from test_text import words_of

from shopwake.llm.components import components
from shopwake.llm.embedding_dedup import near_vectors, shape
from shopwake.llm.ngram_join import TILE, banding, similar_texts, without_copies
from shopwake.llm.tables import Scratch


def closed(nodes, links):
    """Least member of the component of every node."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    links += [(7, 7), (3, 2), (2, 3)]
    df = spark.createDataFrame(links + [(None, 5)], "a long, b long")
    got = {x.node: x.component for x in components(df, Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == closed({n for link in real for n in link}, real)
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.randint(20, 90))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " ,; "), (3, "one two"), (4, "One, two!"), (5, "two one"), (None, "one two"), (None, "lone text here")]
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        rows.append((10 + i, " ".join(w)))
    return rows + rows[20:23] + [(200, "x " * 3000)]


def test_ngram_join_is_whole(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, t, 1, 2, "q") for a, t in rows], "doc_id long, text string, id long, n long, set_key string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words_of(t) for _, t in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    count = Counter(k for link in links for k in link)
    label = closed(range(len(rows)), links)
    ids = defaultdict(list)
    for i, k in label.items():
        ids[k].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = Counter((rows[i][0], rows[i][0] if not sets[i] else least[label[i]], count[i]) for i in range(len(rows)))
    got = Counter((x.doc_id, x.class_id, x.n_links) for x in similar_texts(df, recall=0.99999).collect())
    assert got == want
    kept = without_copies(df, recall=0.99999)
    assert kept.columns == df.columns
    empty = sum(not s for s in sets)
    assert kept.count() == len({label[i] for i in range(len(rows)) if sets[i]}) + empty
    assert {x.doc_id for x in kept.collect() if x.doc_id is not None} >= {v for k, v in least.items() if v is not None}
    assert similar_texts(df.limit(0)).count() == without_copies(df.limit(0)).count() == 0


def test_large_groups_are_cut_into_tiles(spark):
    """A group of more near copies than one tile holds: all links are counted."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    n = TILE + 200
    rows = []
    for i in range(n):
        w = list(base)
        w[i % 150] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(w[: 150 - i % 8])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    seen = {s: k for k, s in enumerate({x for own in sets for x in own})}
    m = np.zeros((n, len(seen)), np.float32)
    for i, own in enumerate(sets):
        m[i, [seen[x] for x in own]] = 1
    common, size = m @ m.T, m.sum(axis=1)
    near = common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-6
    want = near.sum(axis=1) - 1
    got = {x.doc_id: x.n_links for x in similar_texts(df).collect()}
    assert [got[i] for i in range(n)] == want.tolist()


def test_banding_meets_its_recall():
    bands, rows = banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    planes, tables = shape(10_000, 0.95, 5e-4, 64)
    same = 1 - math.acos(0.95) / math.pi
    assert (1 - same**planes) ** tables <= 5e-4


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 16))
    v = [base[r.integers(40)] + r.normal(scale=0.09, size=16) for _ in range(500)]
    v += [v[0], v[0], [2 * x for x in v[1]], [-x for x in v[2]]]
    rows = [(i, [float(np.float32(x)) for x in own]) for i, own in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0] * 8), (907, [1.0] * 8)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows + odd], "vec_id long, embedding array<float>, id long, tile string")
    m = np.array([own for _, own in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.95, 1)
    links = [*zip(*np.nonzero(near))]
    label = closed(range(len(rows)), links)
    count = Counter(k for link in links for k in link)
    want = {i: (count[i], label[i], label[i] == i) for i in range(len(rows))}
    want |= {a: (0, a, True) for a, _ in odd[:6]} | {906: (1, 906, True), 907: (1, 906, False)}
    out = near_vectors(df, loss=1e-9)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in out.collect()} == want
    near_default = {x.vec_id: x.n_links for x in near_vectors(df).collect()}
    assert sum(near_default.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert near_vectors(df.limit(0)).count() == 0
