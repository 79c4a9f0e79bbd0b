"""Collocations: phrases whose words stand together more often than apart.

Only the longest windows are counted. Each word of a piece leads one window of ``longest`` words,
padded with nothing where the piece ends, so the windows that begin with a phrase are as many as its
occurrences: ROLLUP over (language, first word, second, …) then sums ever shorter prefixes, and
no shorter n-gram is ever listed.

Windows are counted inside a part of the texts first; what they add up to is dealt by the hash of a window's
first two words, many windows to a shuffled row. A task then holds all windows of its pairs, so windows below
the least count give up their last words before ROLLUP, which loses no phrase that reaches it: its
parts occur as often as it does at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import Scratch
from .text import LOWER, flat, slices

LONGEST = 3
LEAST_COUNT = 10
TOP = 2000
PART_BYTES = 1 << 20  # text bytes whose windows are counted at once; a longer piece is not cut
LEAST_BUCKETS = 1024  # buckets of first pairs; four for each shuffle partition if that is more
TOP_SHARES = 64  # shares of a language's phrases that are cut to the top before one task ranks them

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``most`` bytes that end with a text or a piece."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + most, n)
        if to < n:
            cut = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if cut <= at:  # inside one text: after a break
                breaks = np.flatnonzero(_KIND[data[at:to]] == _BREAK)
                while not len(breaks) and to < n:
                    low, to = to, min(to + most, n)
                    breaks = np.flatnonzero(_KIND[data[low:to]] == _BREAK) + (low - at)
                end = int(offsets[np.searchsorted(offsets, at, "right")])
                cut = min(end, at + int(breaks[-1]) + 1) if len(breaks) else min(end, to)
            to = cut
        yield at, to
        at = to


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words with '' in front, a hash of each, and every word's code."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inside]))
    coded = words.dictionary_encode()
    values = pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary])
    hashes = np.array([zlib.crc32(w.as_buffer()) for w in values], np.int64)
    return values, hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _packed(key: np.ndarray, more: np.ndarray, size: int) -> np.ndarray:
    """One number for each pair (key, more), in the order of the pairs."""
    if len(key) and int(key.max()) >= (1 << 62) // size:
        key = np.unique(key, return_inverse=True)[1]
    return key * size + more


def counted_windows(longest: int, buckets: int):
    """Arrow function: texts to (bucket, lang, windows): the windows of one part of the texts whose
    first two words fall into this bucket, each as its words and its count, blank between
    them, a line a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART_BYTES):
            langs = batch.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            whole, offsets = flat(batch.column("text"))
            for at, to in _parts(whole, offsets, PART_BYTES):
                data = LOWER[whole[at:to]]
                kind = _KIND[data]
                inside = kind == 0
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets[(offsets >= at) & (offsets <= to)] - at] = True
                first, last = inside.copy(), inside.copy()
                first[1:] &= ~inside[:-1] | edge[1:-1]
                last[:-1] &= ~inside[1:] | edge[1:-1]
                starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
                if not len(starts):
                    continue
                row = np.searchsorted(offsets, starts + at, "right") - 1
                piece = np.cumsum(kind == _BREAK)[starts]
                joined = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)
                values, hashes, code = _codes(data, starts, ends, inside)
                lead = [code]
                follows = joined
                for k in range(1, longest):
                    lead.append(np.where(follows, np.append(code[k:], np.zeros(min(k, len(code)), np.int64)), 0))
                    follows = follows & np.append(joined[k:], np.zeros(min(k, len(code)), bool))
                key = lang_of[row]
                for words in lead:
                    key = _packed(key, words, len(values))
                order = np.argsort(key, kind="stable")
                fresh = np.append(True, key[order[1:]] != key[order[:-1]])
                once = order[fresh]
                count = np.diff(np.append(np.flatnonzero(fresh), len(order)))
                lang, lead = lang_of[row][once], [w[once] for w in lead]
                bucket = (hashes[lead[0]] * 31 + hashes[lead[1]]) % buckets
                order = np.lexsort((lang, bucket))  # stable: windows of a bucket stay in order
                lang, bucket, count = lang[order], bucket[order], count[order]
                begin = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1])))
                text = [values.take(pa.array(w[order])) for w in lead]
                lines = pc.binary_join_element_wise(*text, pa.array(count).cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
                lists = pa.LargeListArray.from_arrays(pa.array(np.append(begin, len(once)).astype(np.int64)), lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[begin].astype(np.int32)), langs.dictionary.cast(pa.string()).take(pa.array(lang[begin])),
                        pc.binary_join(lists, pa.scalar("\n", pa.large_string())).cast(pa.string()),
                    ],
                    ["bucket", "lang", "windows"],
                )
            pa.default_memory_pool().release_unused()

    return run


def phrase_counts(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, size, phrase, f): phrases of up to ``longest`` words that occur ``least`` times or more,
    and for size 0, with an empty phrase, the words of each language."""
    words = [f"w{k}" for k in range(longest)]
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = max(LEAST_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.mapInArrow(counted_windows(longest, buckets), "bucket int, lang string, windows string").repartition("bucket")
    line = dealt.select("bucket", "lang", F.explode(F.split("windows", "\n")).alias("line"))
    windows = line.select("bucket", "lang", F.explode(F.array(F.split("line", " ", -1))).alias("field")).select(
        "bucket", "lang", *(F.get("field", F.lit(k)).alias(w) for k, w in enumerate(words)), F.get("field", F.lit(longest)).cast("long").alias("n")
    )
    # All windows of a pair are in one task, and so are these sums.
    place = ["bucket", "lang", *words]
    windows = windows.groupBy(*place).agg(F.sum("n").alias("n"))
    for k in range(longest - 1, 0, -1):
        total = F.sum("n").over(W.partitionBy(*place[: k + 3])) if k < longest - 1 else F.col("n")
        windows = windows.withColumn("total", total).withColumns({w: F.when(F.col("total") >= least, F.col(w)).otherwise("") for w in words[k:]})
    windows = windows.groupBy(*place).agg(F.sum("n").alias("n"))
    sums = windows.rollup("lang", *words).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    # grouping_id has a bit for each column that a prefix leaves out: 2^j - 1 for the last j.
    size = longest - F.bit_count("left_out")
    phrase = F.concat_ws(" ", *words)
    full = F.col("size") == F.size(F.array_remove(F.array(*(F.coalesce(w, F.lit("")) for w in words)), ""))
    kept = sums.withColumn("size", size).where((F.col("size") == 0) | (F.col("size") > 0) & full & (F.col("f") >= least))
    return scratch.keep(kept.select("lang", F.col("size").cast("int").alias("size"), phrase.alias("phrase"), "f"), "phrases")


def _part(words: Column, at: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, at, length), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, within_percent: int = 50, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to ``longest`` words.

    A candidate occurs ``a`` >= ``least`` times. Cut after its first k words, its parts occur l and r
    times and it scores floor(1000000 * a * a / (l * r)); its lowest cut counts, ties to the shortest first part.
    It goes if a longer candidate holds it and occurs ``within_percent`` of its times or more. Ties of
    score and a are ranked by the phrase's bytes. The arithmetic is in decimals of 38 digits, exact while no
    count passes 15.

    Null texts count as empty, a null lang is ``und``. A very long text is counted in parts that end
    with a piece. Repeated rows count each time. Texts without words and empty tables give no
    rows. Further columns are ignored, whatever their names.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, scratch, longest, least)
    of_language = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    counts = counts.where("size > 0")
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.col("size")

    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda at: _part(F.col("words"), at, k))
    ))
    inside = candidates.where("size > 2").select("lang", "a", F.explode(spans).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * within_percent)
    )

    cut = kept.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("right")
    )
    parts = [counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r"))]
    cut = cut.join(parts[0], ["lang", "left"]).join(parts[1], ["lang", "right"])
    a, left, right = (f"cast({c} as decimal(15,0))" for c in "alr")
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({left} * {right})")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(TOP_SHARES))
    for keys in (["lang", "share"], ["lang"]):
        ranked = (scored.withColumn("share", share) if "share" in keys else scored).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        scored = ranked.where(F.col("rank") <= top)
    return scored.join(of_language, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )
