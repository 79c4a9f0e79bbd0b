import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from shopwake.llm.quality import LABELLERS, expectation_maximisation, quality
from shopwake.llm.toxicity import Ftrl, calibrate, toxicity


def prose(r, n):
    words = ["the", "of", "and", *("".join(r.choice("aeionrst") for _ in range(r.randint(3, 8))) for _ in range(60))]
    out = []
    for k in range(n):
        w = r.choice(words)
        out.append(w.capitalize() if k % 9 == 0 else w + "." if k % 9 == 8 else w)
    return " ".join(out) + "."


def test_ftrl_learns_a_sparse_rule():
    r = np.random.default_rng(1)
    model = Ftrl(50, 0.3, 1.0, 1.0, 1e-3)
    for _ in range(3000):
        x = np.flatnonzero(r.random(50) < 0.2)
        model.step(np.append(x, 0), int(7 in x))
    w = model.weights(slice(None))
    assert w[7] > 2 and np.abs(np.delete(w[1:], 6)).max() < 0.5 * w[7]


def test_toxicity(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = prose(r, r.randint(20, 60)).split()
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["Vile!", "scorn", "grim"]))
        rows.append((i, " ".join(words), "x", 0.5))
        if i % 3:
            labels.append((i, int(bad), 9))
    rows += [(2000, None, "x", 0.1), (2001, "", "x", 0.1), (None, "vile scorn", "x", 0.1), (5, rows[5][1], "x", 0.2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1), (1, labels[0][1], 9)], "doc_id long, toxic int, predicted int")
    got = toxicity(df, lab).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    truth = {i: i % 5 == 0 for i in range(900)}
    for x in got:
        assert x.held_out == (crc32(str("" if x.doc_id is None else x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    by_id = {x.doc_id: x.score for x in got}
    assert by_id[2000] == by_id[2001] < 0.5
    # What is held out has no part in fitting.
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity(df, flipped).collect()} == by_id
    one = toxicity(df, lab.where("toxic = 0")).collect()
    assert len({x.score for x in one}) == 1
    assert toxicity(df.limit(0), lab).count() == 0
    assert toxicity(df, lab.limit(0)).count() == len(rows)


def test_toxicity_finds_rare_texts_whatever_the_sample(spark):
    """Few toxic rows among many: a bounded sample shifts the prior, not what 0.5 finds."""
    r = random.Random(4)
    rows = []
    for i in range(3000):
        words = prose(r, r.randint(20, 60)).split()
        if i % 20 == 0:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["Vile!", "scorn", "grim"]))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    lab = df.select("doc_id", (F.col("doc_id") % 20 == 0).cast("int").alias("toxic"))
    for most in (90, 5000):
        held = [x for x in toxicity(df, lab, per_label=most).where("held_out").collect()]
        toxic = [x.predicted for x in held if x.doc_id % 20 == 0]
        assert len(toxic) > 20 and sum(toxic) >= 0.9 * len(toxic), most
        assert sum(x.predicted for x in held if x.doc_id % 20) <= 0.1 * len(toxic), most


def test_calibration_is_weighted_and_finite():
    r = np.random.default_rng(5)
    x = r.normal(size=40_000) * 2
    y = (r.random(40_000) < 1 / (1 + np.exp(-(2 * x - 3)))).astype(int)
    own = (y == 1) | (r.random(40_000) < 0.3)
    slope, offset = calibrate(x[own], y[own], np.where(y[own] == 1, 1, 1 / 0.3))
    assert abs(slope - 2) < 0.15 and abs(offset + 3) < 0.2
    slope, offset = calibrate(np.array([-1.0, -1.0, 1.0, 1.0]), np.array([0, 0, 1, 1]), np.ones(4))
    assert 0 < slope < 5 and abs(offset) < 1e-6
    assert calibrate(np.array([1.0, 1.0, -1.0, -1.0]), np.array([0, 0, 1, 1]), np.ones(4)) == (0.0, 0.0)


def junk(r, n):
    words = prose(r, n).split()
    kind = r.randrange(4)
    if kind == 0:
        return " ".join(w + "%%%" for w in words)
    if kind == 1:
        return "!! ".join(words).upper()
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[: n // 12] for _ in range(12))


def test_quality(spark):
    r = random.Random(6)
    good = [prose(r, r.randint(30, 200)) for _ in range(500)]
    bad = [junk(r, r.randint(60, 200)) for _ in range(90)]
    short = ["This.", "De.", "One two three.", "", None, "The end of it."]
    rows = [(i, t) for i, t in enumerate(good + bad + short + good[:2])]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, _row string")
    got = quality(df).select("_row.doc_id", "_row._row", "score", "weak_label").collect()
    assert len(got) == len(rows)
    kept = {x.doc_id for x in got if x.score >= 0.5}
    assert {*range(500), *range(590, len(rows))} <= kept
    assert len(kept & {*range(500, 590)}) <= 2
    assert quality(df.limit(0)).count() == 0


def test_quality_of_one_row_many_times(spark):
    rows = spark.range(13_000).selectExpr("1L AS doc_id", "'the same text of a few words' AS text", "0 AS all", "1L AS tie")
    got = quality(rows, sample_rows=10)
    assert got.count() == 13_000 and got.select("score").distinct().count() == 1


def test_em_finds_the_better_labellers():
    r = np.random.default_rng(2)
    truth = r.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.6])
    said = np.where(r.random((4000, 3)) < right, truth[:, None], ~truth[:, None]).astype(int)
    said[r.random((4000, 3)) < 0.2] = -1
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    p, accuracy = expectation_maximisation(patterns, counts.astype(float))
    assert accuracy[0] > accuracy[2] and accuracy[1] > accuracy[2]
    at = {tuple(x): v for x, v in zip(patterns, p)}
    assert np.mean([(at[tuple(x)] > 0.5) == t for x, t in zip(said, truth)]) > 0.88
    assert len(LABELLERS) == 7
