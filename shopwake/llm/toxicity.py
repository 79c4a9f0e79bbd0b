"""Toxicity scores: FTRL-proximal logistic regression on hashed word n-grams.

Features are the words, word pairs and pairs with one word between (skip-grams)
of a text, each once, hashed to 32 bits. Per-coordinate learning rates and L1
leave few weights that are not zero; those are broadcast. L1 and few passes leave
the sums of a text short, so slope and offset are calibrated on rows left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import sample
from .text import Words, distinct, flat, list_array, mix, slices, stream

TRAIN_PER_LABEL = 5_000  # labelled rows of each label used for fitting
FOLDS = 5  # models behind the calibration
_C = stream(8, 6) | np.uint64(1)
_SIEVE = (1 << 22) - 1


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram occurrence."""
    h = words.hash
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    out, rows = [mix(h * _C[0])], [row]
    for gap, c in ((1, _C[1]), (2, _C[2])):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            out.append(mix(h[:-gap] * c + h[gap:] * _C[3])[same])
            rows.append(row[:-gap][same])
    return (np.concatenate(out) >> np.uint64(32)), np.concatenate(rows)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(*flat(batch.column("text")))
        hashes, rows = _features(words)
        order = np.argsort(rows, kind="stable")
        values, at = distinct(hashes[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), list_array(values, at)], ["doc_id", "label", "features"])


class Ftrl:
    """FTRL-proximal on binary features; one row at a time."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _trained(rows: list[np.ndarray], labels: np.ndarray, size: int, *, passes: int = 6, alpha: float = 0.3, l1: float = 1.5, seed: int = 1) -> np.ndarray:
    model = Ftrl(size, alpha, 1.0, l1, 1e-3)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            model.step(rows[i], int(labels[i]))
    return model.weights(slice(None))


def calibrate(sums: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, offset) that make a probability of ``sums``: weighted logistic
    regression. Targets are short of 0 and 1 by a row each, so that separable
    sums have a finite slope."""
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([sums, np.ones(len(sums))], axis=1)

    def loss(v):
        t = x @ v
        return float((weight * (np.logaddexp(0, t) - target * t)).sum())

    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        g = x.T @ (weight * (p - target))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), g)
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if at[0] <= 0:  # the sums say nothing
        p = float(np.clip((weight * target).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        return 0.0, float(np.log(p / (1 - p)))
    return float(at[0]), float(at[1])


def fit(features: list[np.ndarray], labels: np.ndarray, rate: float, *, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, weights, bias) of the calibrated sum; ``rate`` is the share of label 1
    among all rows, to which the rows given are weighted.

    The slope and offset of the sum are fitted to sums of rows that the model
    behind them was not fitted on: ``folds`` models leave out a part of each
    label each. A label of one row cannot be left out; then the bias alone is
    moved to the rate."""
    if not len(labels) or labels.min() == labels.max():
        p = min(max(rate, 1e-3), 1 - 1e-3)
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p)))
    every = np.concatenate(features).view(np.uint64)
    known, times = np.unique(every, return_counts=True)
    known = known[times > 1]  # one row alone cannot outweigh L1
    del every, times
    local = []
    for f in features:
        f = f.view(np.uint64)
        at = np.searchsorted(known, f)
        at[at == len(known)] = 0
        own = at[known[at] == f] if len(known) else np.zeros(0, np.int64)
        local.append(np.append(own, len(known)).astype(np.int64))  # the last one is the bias
    size = len(known) + 1
    w = _trained(local, labels, size)
    ones = int((labels == 1).sum())
    share = ones / len(labels)
    folds = min(folds, ones, len(labels) - ones)
    if folds > 1:
        part = np.zeros(len(labels), np.int64)
        for y in (0, 1):
            own = np.flatnonzero(labels == y)
            part[np.random.default_rng(2 + y).permutation(own)] = np.arange(len(own)) % folds
        sums = np.zeros(len(labels))
        for k in range(folds):
            v = _trained([local[i] for i in np.flatnonzero(part != k)], labels[part != k], size)
            for i in np.flatnonzero(part == k):
                sums[i] = v[local[i]].sum()
        slope, offset = calibrate(sums, labels, np.where(labels == 1, rate / share, (1 - rate) / (1 - share)))
    else:
        slope, offset = 1.0, np.log(rate / (1 - rate)) - np.log(share / (1 - share)) if 0 < rate < 1 else 0.0
    some = np.flatnonzero(w[:-1])
    return known[some], slope * w[some], float(slope * w[-1] + offset)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, bias = shared.value
        sieve = np.zeros(_SIEVE + 1, bool)
        sieve[(hashes & np.uint64(_SIEVE)).astype(np.int64)] = True
        for batch in slices(batches, "text"):
            found, rows = _features(Words(*flat(batch.column("text"))))
            total = np.full(batch.num_rows, bias)
            if len(hashes):
                maybe = sieve[(found & np.uint64(_SIEVE)).astype(np.int64)]
                found, rows = found[maybe], rows[maybe]
                at = np.searchsorted(hashes, found)
                at[at == len(hashes)] = 0
                hit = hashes[at] == found
                pairs = np.unique(rows[hit] * len(hashes) + at[hit])  # each feature once per text
                np.add.at(total, pairs // len(hashes), weights[pairs % len(hashes)])
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def held_out(key: Column) -> Column:
    """True for the fifth of the rows that fitting never sees."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, *, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (0 or 1).

    The model is fitted on ``per_label`` labelled documents of each label at most,
    those of least hash, none of them held out; scores are calibrated by models that
    leave out a part of those each, weighted to the rate among all labelled rows that
    are not held out. Scores see the text alone. Null and empty texts
    have no features and get the score of the bias. Null labels and ids are not
    used for fitting; without two labels all scores are the rate. Repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().where("label in (0, 1)").collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = [sample(known.where(F.col("label") == y), F.xxhash64("doc_id"), per_label, counts.get(y, 0)) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).drop("tie").dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]
    features = texts.mapInArrow(_sample_features, f"doc_id {kind}, label int, features array<long>").dropDuplicates(["doc_id"])
    # Rows in a fixed order, so that reruns agree.
    table = features.toArrow().sort_by("doc_id")
    arrays = [np.asarray(a) for a in table.column("features").to_numpy()]
    model = fit(arrays, table.column("label").to_numpy(), rate)
    del table, arrays
    shared = spark.sparkContext.broadcast(model)
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
