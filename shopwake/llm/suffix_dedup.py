"""Bytes inside long repeated strings, by bucket-pointer refinement.

A suffix array would sort every byte position by what follows. Here only depth
``min_bytes`` matters and only positions that share a bucket go on:

1. A position's bucket identifier is a fingerprint of the q bytes there. The
   identifier at depth 2d is made from those at depth d of the position and of
   the position d later, so each refinement reuses the one before: 1, 2, 4 ...
   bytes, then ``min_bytes`` from two overlapping powers of two.
2. Every start is represented by the least q-gram of its string (leftmost if
   equal), which equal strings have at the same offset. The starts of one
   representative form a run; runs are dealt to buckets by the q-gram.
   A bucket of one run holds no repeated string and is done.
3. Runs of a shared bucket are refined by the identifiers of all the bytes
   their strings cover. Equal runs are repeated as a whole.
4. Runs alone in their class, in a bucket of several classes, are cut into
   cells of starts by their offset from the representative. What all strings of
   a cell have in common is its core: cells are dealt to buckets by offset and core,
   and those alone there are done. Equal cells are repeated as a whole.
5. The cells that are left, where near copies begin to differ, are refined to single
   starts: (bucket, offset, identifier at full depth), once for each class.

Identifiers are 64 bits; a start is compared on bucket and full depth, 128.
Texts equal as a whole are one class with a count from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import Scratch
from .text import flat, list_array, mix, slices, stream

BUFFER = 2 << 20  # bytes of text refined at once
_PLACE = np.uint64((1 << 23) - 1)
_C = stream(5, 8) | np.uint64(1)
_BYTE = stream(6, 256)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _C[0]
    z += y * _C[1]
    z ^= z >> np.uint64(32)
    return z


def _depths(min_bytes: int) -> tuple[int, int, int]:
    """(q, largest power of two up to ``min_bytes``, starts in a cell)."""
    top = 1 << (min_bytes.bit_length() - 1)
    return max(1, top // 4), top, min(32, min_bytes - top + 1)


def _identifiers(data: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers of the q bytes, of a cell's core and of the ``min_bytes`` bytes at each place."""
    q, top, cell = _depths(min_bytes)
    now, depth = _BYTE[data], 1
    grams = now if q == 1 else None
    while depth < top:
        now = _pair(now[:-depth], now[depth:])
        depth *= 2
        if depth == q:
            grams = now
    core, rest = min_bytes - cell + 1 - top, min_bytes - top
    return grams, _pair(now[: len(now) - core], now[core:]), _pair(now[: len(now) - rest], now[rest:])


def _representatives(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``width`` q-grams from each place on."""
    key = mix(grams) & ~_PLACE
    key |= np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    return (key & _PLACE).astype(np.int64)


def _pieces(batch: pa.RecordBatch, min_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its text): the
    texts of a batch, one long text in overlapping pieces."""
    data, offsets = flat(batch.column("text"))
    if batch.num_rows == 1 and len(data) > 2 * BUFFER:
        for at in range(0, len(data) - min_bytes + 1, BUFFER):
            part = data[at : at + BUFFER + min_bytes - 1]
            yield 0, part, np.array([0, len(part)]), at
    else:
        yield 0, data, offsets, 0


def _runs(min_bytes: int):
    """One row per run: keys of the text, bucket, region, first and last start, anchor."""
    q, _, _ = _depths(min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BUFFER):
            for _, data, offsets, shift in _pieces(batch, min_bytes):
                if len(data) < min_bytes:
                    continue
                grams, _, full = _identifiers(data, min_bytes)
                anchor = _representatives(grams, min_bytes - q + 1)
                n = len(full)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
                fits = np.arange(n) + min_bytes <= offsets[row + 1]
                new = np.ones(n, bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~fits[:-1]
                low = np.flatnonzero(new & fits)
                if not len(low):
                    continue
                stop = np.flatnonzero(fits & np.append(new[1:] | ~fits[1:], True))
                at = anchor[low]
                region = _pair(full[low] + (stop - low).astype(np.uint64) * _C[2], full[stop] + (at - low).astype(np.uint64) * _C[3])
                base = shift - offsets[row[low]]
                take = pa.array(row[low])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("t1", "t2", "n")), pa.array(grams[at].view(np.int64)), pa.array(mix(region).view(np.int64)),
                     *(pa.array(x + base) for x in (low, stop, at))],
                    ["t1", "t2", "n", "bucket", "region", "low", "high", "anchor"],
                )

    return run


RUNS = "t1 long, t2 long, n long, bucket long, region long, low long, high long, anchor long"


def _asked(batches: Iterator[pa.RecordBatch], min_bytes: int):
    """(batch, place of the piece in its text, offsets, identifiers, rows and runs asked for) of
    each piece; the runs are cut to the piece and given by places in it."""
    for batch in slices(batches, "text", BUFFER):
        for _, data, offsets, shift in _pieces(batch, min_bytes):
            if len(data) < min_bytes:
                continue
            owner, asked = [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                for r in runs:
                    low, high = max(r["low"] - shift, 0), min(r["high"] - shift, offsets[i + 1] - offsets[i] - min_bytes)
                    if low <= high:
                        owner.append(i)
                        asked.append((low + offsets[i], high + offsets[i], r["anchor"] - shift + offsets[i], r["bucket"], r["asks"]))
            if asked:
                _, core, full = _identifiers(data, min_bytes)
                yield batch, shift, offsets, core, full, np.array(owner), tuple(np.array(x) for x in zip(*asked))


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``size`` consecutive numbers from each of ``first``, and whose they are."""
    own = np.repeat(np.arange(len(size)), size)
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()), own


def _cells(min_bytes: int):
    """One row per cell of the runs asked for: (bucket, offset), core, and all bytes of a cell that is whole."""
    cell = _depths(min_bytes)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shift, offsets, core, full, owner, (low, high, anchor, bucket, asks) in _asked(batches, min_bytes):
            number, own = _spread((anchor - high) // cell, (anchor - low) // cell - (anchor - high) // cell + 1)
            last = anchor[own] - number * cell  # the last start that the cell can have
            first = last - cell + 1
            whole = (first >= low[own]) & (last <= high[own])
            spot = mix(bucket.astype(np.int64).view(np.uint64)[own] + number.astype(np.uint64) * _C[5])
            region = np.where(whole, _pair(full[np.where(whole, first, 0)], full[np.where(whole, last, 0)]), np.uint64(0))
            row = owner[own]
            base = shift - offsets[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1").take(take), batch.column("t2").take(take), pa.array(spot.view(np.int64)), pa.array(core[last].view(np.int64)),
                 pa.array(region.view(np.int64)), pa.array(whole), pa.array(np.maximum(first, low[own]) + base), pa.array(np.minimum(last, high[own]) + base),
                 pa.array(anchor[own] + base), pa.array(bucket[own].astype(np.int64)), pa.array(asks[own])],
                ["t1", "t2", "spot", "core", "region", "whole", "low", "high", "anchor", "bucket", "asks"],
            )

    return run


CELLS = "t1 long, t2 long, spot long, core long, region long, whole boolean, low long, high long, anchor long, bucket long, asks boolean"


def _starts(min_bytes: int):
    """One row per start of the runs asked for: (bucket, offset) and full identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shift, offsets, _, full, owner, (low, high, anchor, bucket, asks) in _asked(batches, min_bytes):
            place, own = _spread(low, high - low + 1)
            spot = mix(bucket.astype(np.int64).view(np.uint64)[own] + (anchor[own] - place).astype(np.uint64) * _C[4])
            row = owner[own]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1").take(take), batch.column("t2").take(take), pa.array(spot.view(np.int64)), pa.array(full[place].view(np.int64)),
                 pa.array(place - offsets[row] + shift), pa.array(asks[own])],
                ["t1", "t2", "spot", "full", "start", "asks"],
            )

    return run


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:] - 1, len(low) - 1)] if len(low) else high


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans of each text and the digest of what stays."""
    for batch in slices(batches, "text", BUFFER):
        data, offsets = flat(batch.column("text"))
        begins, ends, digests, at = [], [], [], [0]
        lows, highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
        for i in range(batch.num_rows):
            low, high = merged(np.array(lows[i] or [], np.int64), np.array(highs[i] or [], np.int64))
            own, digest, kept_to = data[offsets[i] : offsets[i + 1]], hashlib.sha256(), 0
            for begin, end in zip(low.tolist(), high.tolist()):
                digest.update(own[kept_to:begin])
                kept_to = end
            digest.update(own[kept_to:])
            digests.append(digest.hexdigest())
            begins.append(low)
            ends.append(high)
            at.append(at[-1] + len(low))
        at = np.array(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("t1"), batch.column("t2"), list_array(np.concatenate(begins), at), list_array(np.concatenate(ends), at), pa.array(digests)],
            ["t1", "t2", "lows", "highs", "kept_sha256"],
        )


def repeated_bytes(docs: DataFrame, *, min_bytes: int = 400) -> DataFrame:
    """One row per document: doc_id, n_bytes, ``lows`` and ``highs`` (the maximal
    runs of bytes to remove, end exclusive) and kept_sha256.

    A byte is removed if a string of ``min_bytes`` bytes over it also starts
    anywhere else, in the same text or another, overlaps included; all strings are
    judged on the input. Null texts are empty; texts shorter than ``min_bytes``
    keep all; equal texts and repeated rows repeat each other whole. An empty table
    gives no rows; columns besides doc_id and text are ignored. Very long texts are
    judged whole, in parts. Of equal strings none is preferred: all go.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text")).withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text", F.length("text")))
    # Partial counts meet copies before the shuffle, so a frequent text moves once per task.
    texts = rows.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.first("text").alias("text")).where(F.length("text") >= min_bytes)
    path, name = f"{scratch.root}/texts", "texts_" + scratch.root.rpartition("-")[2]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (texts.repartition(parts, "t1", "t2").write.option("compression", "zstd").option("path", path)
        .bucketBy(parts, "t1", "t2").saveAsTable(name))
    texts = spark.table(name)
    runs_at = scratch.mark()
    runs = scratch.keep(texts.mapInArrow(_runs(min_bytes), RUNS), "runs")
    buckets = runs.groupBy("bucket").agg(F.sum("n").alias("n"), (F.min("region") != F.max("region")).alias("several"))
    buckets = scratch.keep(buckets.where("n > 1").drop("n"), "buckets")
    live = scratch.keep(runs.join(buckets, "bucket"), "live")
    first = F.min(F.struct("t1", "t2", "low", "high", "anchor")).alias("first")
    regions = scratch.keep(live.groupBy("bucket", "region").agg(F.sum("n").alias("m"), F.first("several").alias("several"), first), "regions")
    whole = live.where("n = 1").join(regions.where("m > 1").select("bucket", "region"), ["bucket", "region"], "left_semi")
    whole = whole.select("t1", "t2", "low", (F.col("high") + min_bytes).alias("high"))
    scratch.drop(runs_at, runs_at + 1)

    def listed(runs: DataFrame) -> DataFrame:
        """Each text with the runs asked for in it; the table's buckets spare a shuffle of texts."""
        asked = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("low", "high", "anchor", "bucket", "asks")).alias("runs"))
        return texts.join(asked, ["t1", "t2"]).select("t1", "t2", "text", "runs")

    cells = listed(regions.where("several").select("first.*", "bucket", (F.col("m") == 1).alias("asks"))).mapInArrow(_cells(min_bytes), CELLS)
    cells = scratch.keep(cells, "cells")
    several = (F.min("region") != F.max("region")) | ~F.min("whole")
    cores = scratch.keep(cells.groupBy("spot", "core").agg(F.count("*").alias("m"), several.alias("several")).where("m > 1").drop("m"), "cores")
    near = scratch.keep(cells.join(cores, ["spot", "core"]), "near")
    first = F.min(F.struct("t1", "t2", "low", "high", "anchor", "bucket", "asks")).alias("first")
    kinds = near.where("whole").groupBy("spot", "core", "region").agg(F.count("*").alias("m"), F.first("several").alias("several"), first)
    kinds = scratch.keep(kinds, "kinds")
    equal = near.where("asks and whole").join(kinds.where("m > 1").select("spot", "core", "region"), ["spot", "core", "region"], "left_semi")
    equal = equal.select("t1", "t2", "low", (F.col("high") + min_bytes).alias("high"))
    ends = ["t1", "t2", "low", "high", "anchor", "bucket"]
    left = kinds.where("several").select(*(f"first.{c}" for c in ends), (F.col("first.asks") & (F.col("m") == 1)).alias("asks"))
    left = left.unionByName(near.where("not whole").select(*ends, "asks"))
    starts = scratch.keep(listed(left).mapInArrow(_starts(min_bytes), "t1 long, t2 long, spot long, full long, start long, asks boolean"), "starts")
    twice = scratch.keep(starts.groupBy("spot", "full").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "twice")
    single = starts.where("asks").join(twice, ["spot", "full"], "left_semi")
    single = single.select("t1", "t2", F.col("start").alias("low"), (F.col("start") + min_bytes).alias("high"))
    cover = whole.unionByName(equal).unionByName(single).groupBy("t1", "t2").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    own = texts.where("n = 1").select("t1", "t2", "text").join(cover, ["t1", "t2"])
    own = own.mapInArrow(_kept, "t1 long, t2 long, lows array<long>, highs array<long>, kept_sha256 string")
    copies = texts.where("n > 1").select("t1", "t2", F.array(F.lit(0).cast("long")).alias("lows"), F.array(F.length("text").cast("long")).alias("highs"),
                                         F.sha2(F.lit(""), 256).alias("kept_sha256"))
    spans = scratch.keep(own.unionByName(copies), "spans")
    spark.sql(f"DROP TABLE {name}")  # what the result needs of it is written
    none = F.array().cast("array<long>")
    return rows.select("doc_id", "t1", "t2", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")).join(
        spans, ["t1", "t2"], "left"
    ).select("doc_id", "n_bytes", F.coalesce("lows", none).alias("lows"), F.coalesce("highs", none).alias("highs"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
