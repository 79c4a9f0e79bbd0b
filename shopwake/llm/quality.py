"""Text quality without labels: EM over heuristic labellers, then a scorer.

Labellers vote junk, good or nothing on every text. How often each is right
follows from how they agree: expectation-maximisation over the counts of vote
patterns. The posterior of a text's pattern is its weak label; a linear scorer on hashed
character-class trigrams is fitted to those of a sample and judges every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import packed, sample_each, with_fields
from .text import Words, flat, list_array, mix, slices, stream

SAMPLE_ROWS = 6_000  # texts the scorer is fitted on
FEATURES = 1024
LEAST = 200  # features of a text of so many characters count half: few say little
LABELLERS = ("symbols", "capitals", "repeats", "bars", "marks", "variety", "sentences")

# Character classes: one per ASCII sign, and one each for space, digits, capitals, others.
_CLASS = np.full(256, 3, np.uint64)
_CLASS[:33], _CLASS[48:58], _CLASS[65:91] = 0, 1, 2
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 4 + _i
_SLOT = (mix(np.arange(1 << 18, dtype=np.uint64) * (stream(9, 1)[0] | np.uint64(1))) % np.uint64(FEATURES)).astype(np.int64)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*b"#$%&*|!<>{}[]~^\\=+_"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def votes(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Votes of each labeller (columns as in LABELLERS) on each text: 1 junk,
    0 good, -1 nothing. Texts of under ten words get votes on symbols only."""
    n_words = np.maximum(words.counts, 1).astype(np.float64)
    n_bytes = np.maximum(np.diff(offsets), 1).astype(np.float64)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    first = np.zeros(len(words.hash), bool)
    order = np.lexsort((words.hash, row))
    first[order] = np.append(True, (words.hash[order][1:] != words.hash[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(order)]
    upper, alpha = _sums(_UPPER[data], offsets), np.maximum(_sums(_ALPHA[data], offsets), 1)
    signs = _sums(_SIGN[data], offsets)
    bars = _sums(data == 124, offsets)
    marks = np.zeros(len(data), bool)  # a sign twice or more in a row
    marks[1:] = (data[1:] == data[:-1]) & (_SIGN[data[1:]] | (data[1:] == 46))
    points = _sums((data == 46) | (data == 63) | (data == 33), offsets)
    at = words.at
    repeats = _sums(again, at) / n_words
    kinds = _sums(first, at) / n_words
    expected = np.minimum(1.0, 3 / np.sqrt(n_words))  # natural text repeats more the longer it is

    def vote(value, junk, good=-np.inf):
        return np.where(value >= junk, 1, np.where(value <= good, 0, -1))

    out = np.stack(
        [
            vote(signs / n_bytes, 0.04),
            vote(upper / alpha, 0.5),
            vote(repeats, 0.15),
            vote(bars / n_words, 0.1),
            vote(_sums(marks, offsets) / n_words, 0.15),
            vote(-kinds / expected, -0.3, -0.7),
            vote(-points / n_words, -0.002, -0.03),
        ],
        axis=1,
    ).astype(np.int8)
    short = words.counts < 10
    out[short, 1:] = -1
    out[np.diff(offsets) == 0] = -1
    return out


def features(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Square roots of the shares of hashed character-class trigrams, and of
    words equal to the one before."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES + 1), np.float32)
    if len(data) > 2:
        c = _CLASS[data]
        slot = _SLOT[((c[:-2] * np.uint64(64) + c[1:-1]) * np.uint64(64) + c[2:]).astype(np.int64)]
        row = np.repeat(np.arange(n), np.diff(offsets))
        same = row[:-2] == row[2:]
        out[:, :-1] = np.bincount(row[:-2][same] * FEATURES + slot[same], minlength=n * FEATURES).reshape(n, FEATURES)
    total = out[:, :-1].sum(axis=1, keepdims=True)
    out[:, :-1] /= np.maximum(total, 1)
    owner = np.repeat(np.arange(n), words.counts)
    again = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    out[:, -1] = np.bincount(owner[1:][again], minlength=n) / np.maximum(words.counts, 1)
    return np.sqrt(out) * (total / (total + LEAST)).astype(np.float32)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of junk per pattern, accuracy of each labeller's votes): two
    classes; junk, good and no vote are independent within a class; at the start, texts
    with any junk vote are likely junk."""
    votes_as = [patterns == v for v in (-1, 0, 1)]
    silent = votes_as[0].all(axis=1)  # says nothing: it has the prior
    p = np.where((patterns == 1).any(axis=1), 0.9, 0.05)
    says = np.zeros((2, 3, patterns.shape[1]))  # class, vote, labeller
    for _ in range(rounds):
        prior = np.clip((counts * ~silent * p).sum() / max((counts * ~silent).sum(), 1), 1e-4, 1 - 1e-4)
        log = []
        for k, weight in enumerate((counts * ~silent * (1 - p), counts * ~silent * p)):
            for v, here in enumerate(votes_as):
                says[k, v] = ((weight[:, None] * here).sum(axis=0) + 0.1) / (weight.sum() + 0.3)
            log.append(sum(np.where(here, np.log(says[k, v]), 0).sum(axis=1) for v, here in enumerate(votes_as)) + np.log((1 - prior, prior)[k]))
        p = np.where(silent, prior, 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))
    right = says[0, 1] * (1 - prior) + says[1, 2] * prior
    wrong = says[0, 2] * (1 - prior) + says[1, 1] * prior
    return p, right / (right + wrong)


def fit(x: np.ndarray, p: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights (the bias last) of a logistic scorer of ``p``, by accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1], np.float32)
    v, rate = w.copy(), 4 / max(1e-6, float((x * x).sum(axis=1).mean()))
    for k in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - p).astype(np.float32) / max(len(x), 1) + l2 * v
        new = v - rate * g
        v, w = new + k / (k + 3) * (new - w), new
    return w


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = flat(batch.column("text"))
        said = votes(data, offsets, Words(data, offsets)).astype(np.int64) + 1
        yield pa.RecordBatch.from_arrays([pa.array(said @ 3 ** np.arange(len(LABELLERS)))], ["pattern"])


def _unpack(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = flat(batch.column("text"))
        words = Words(data, offsets)
        said = votes(data, offsets, words).astype(np.int64) + 1
        x = features(data, offsets, words)
        at = np.arange(len(x) + 1) * x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tie"), pa.array(said @ 3 ** np.arange(len(LABELLERS))), list_array(x.ravel(), at, pa.float32())], ["tie", "pattern", "x"]
        )


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, posterior, w = shared.value
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            words = Words(data, offsets)
            said = (votes(data, offsets, words).astype(np.int64) + 1) @ 3 ** np.arange(len(LABELLERS))
            junk = 1 / (1 + np.exp(-np.clip(features(data, offsets, words) @ w[:-1] + w[-1], -30, 30)))
            weak = posterior[np.minimum(np.searchsorted(patterns, said), len(patterns) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("text"), pa.array(1.0 - junk.astype(np.float64)), pa.array(1.0 - weak)], ["_row", "text", "score", "weak_label"]
            )

    return run


def quality(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows packed as ``_row`` and text, with ``score`` and ``weak_label``: the
    scorer's and the labellers' probability that a text is good.

    Vote patterns are counted over all texts (there are 3^7 at most); the scorer is
    fitted on about ``sample_rows`` different rows at most, those of least hash, one of them at least.
    Null and empty texts get no votes and have no features: their score is that of the bias. A
    very long text is scored whole. Repeated rows are scored each, and are one row of the sample; ties of the
    hash are the same row. An empty table gives no rows; other columns pass through in the struct.
    """
    spark = docs.sparkSession
    text = packed(docs)
    counted = text.select("text").mapInArrow(_vote_rows, "pattern long").groupBy("pattern").count().orderBy("pattern").collect()
    patterns = np.array([r.pattern for r in counted], np.int64)
    if not len(patterns):
        return text.select("_row", "text", F.lit(0.0).alias("score"), F.lit(0.0).alias("weak_label"))
    posterior, _ = expectation_maximisation(_unpack(patterns), np.array([r["count"] for r in counted], np.float64))
    chosen, _ = sample_each(text.withColumn("all", F.lit(0)), "all", F.xxhash64("_row", "text"), sample_rows)
    table = chosen.select("text", "tie").mapInArrow(_sample_rows, "tie long, pattern long, x array<float>").toArrow()
    order = np.argsort(table.column("tie").to_numpy(), kind="stable")
    x = np.stack(table.column("x").to_numpy())[order]
    weak = posterior[np.searchsorted(patterns, table.column("pattern").to_numpy()[order])]
    shared = spark.sparkContext.broadcast((patterns, posterior, fit(x, weak)))
    return text.mapInArrow(_judge(shared), with_fields(text, "score double, weak_label double"))
