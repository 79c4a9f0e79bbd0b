"""Benchmark words inside documents, by one Aho-Corasick automaton.

The automaton reads words instead of letters: each word of the items has a code
point, so a text is a short string and matches are whole words. Its patterns
are the items cut into pieces of ``(window + 1) // 2`` words: any ``window``
consecutive item words hold one piece whole. A match is prolonged to both sides
as far as item and text agree; runs of ``window`` words or more are hits. Items
shorter than a window are patterns as a whole. Longer ones are cut into segments that
share ``window - 1`` words, so each window lies whole in one and runs are merged
again. A text is scanned once; word places are mapped back to its own characters.
"""

from __future__ import annotations

import math
import os
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import Scratch, packed, with_fields
from .text import Words, flat, slices

ITEM_BYTES = 4 << 20  # item words, as hashes, in one automaton; more items take more passes
_BUILT: dict[bytes, tuple] = {}  # the last automaton of a worker, by a name that the driver made up


def _segments(window: int, most: int):
    """Items as hashes of their words, in segments of ``most`` words that share
    ``window - 1``, one at least: each window lies whole in one, and a run over
    several is made of hits that overlap."""
    shared = max(1, window - 1)
    most = max(most, 2 * shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*flat(batch.column("text")))
            for k, item in enumerate(batch.column("item")):
                own = words.hash[words.at[k] : words.at[k + 1]]
                for at in range(0, max(1, len(own) - shared), most - shared):
                    part = pa.array([own[at : at + most].tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], pa.string()), part], ["item", "words"])

    return run


def _build(items: list[tuple[str | None, bytes]], window: int) -> tuple:
    """Vocabulary, automaton, and word codes and id of every segment of an item."""
    hashes = [np.frombuffer(t, np.uint64) for _, t in items]
    at_item = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
    vocabulary, code = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
    codes = (code + 1).tolist()
    listed, pieces, piece = [], defaultdict(list), (window + 1) // 2
    for k, (item, _) in enumerate(items):
        own = codes[at_item[k] : at_item[k + 1]]
        listed.append((item, own))
        size = piece if len(own) >= window else len(own)
        for at in range(0, len(own) - size + 1, size) if size else ():
            pieces[_letters(own[at : at + size])].append((k, at, size))
    automaton = ahocorasick.Automaton()
    for text, places in pieces.items():
        automaton.add_word(text, places)
    automaton.make_automaton()
    return vocabulary, automaton, listed


def _letters(codes: list[int]) -> str:
    return "".join([chr(c if c < 0xD800 else c + 0x800) for c in codes])


def _hits(codes: list[int], automaton, listed, window: int) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of words that items have, and the ids of those items."""
    runs, found, seen = [], set(), {}
    n = len(codes)
    for end, places in automaton.iter(_letters(codes)):
        for k, at, size in places:
            item, own = listed[k]
            low, first = end - size + 1, at
            line = (k, low - first)
            if seen.get(line, -1) >= low:
                continue
            high, last = end + 1, at + size
            while high < n and last < len(own) and codes[high] == own[last]:
                high, last = high + 1, last + 1
            while low and first and codes[low - 1] == own[first - 1]:
                low, first = low - 1, first - 1
            seen[line] = high
            if high - low >= min(window, len(own)):
                runs.append((low, high))
                if item is not None:
                    found.add(item)
    return runs, found


def _scan(shared, window: int):
    """Add the hits of one automaton to those a row carries already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = shared.value
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = _build(items, window)
        vocabulary, automaton, listed = _BUILT[key]
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            words = Words(data, offsets)
            place = np.searchsorted(vocabulary, words.hash)
            place[place == len(vocabulary)] = 0
            codes = np.where(vocabulary[place] == words.hash, place + 1, 0) if len(vocabulary) else np.zeros(len(place), np.int64)
            earlier, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            all_hits, all_items = [], []
            for i in range(batch.num_rows):
                low, high = words.at[i], words.at[i + 1]
                own = codes[low:high]
                runs, found = _hits(own.tolist(), automaton, listed, window) if own.any() else ([], set())
                if runs:
                    lead = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                    for a, b in runs:
                        ends = words.start[low + a] - offsets[i], words.end[low + b - 1] - offsets[i]
                        earlier[i].append({"word": int(a), "to_word": int(b), "start": int(lead[ends[0]]), "end": int(lead[ends[1]])})
                all_hits.append(_merged(earlier[i]))
                all_items.append(sorted({*items[i], *found}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("text"), pa.array(words.counts.astype(np.int64)),
                 pa.array(all_hits, _HIT_TYPE), pa.array(all_items, pa.list_(pa.string()))],
                ["_row", "text", "n_words", "hits", "items"],
            )

    return run


_HIT_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "to_word", "start", "end")]))
HITS = "array<struct<word:long,to_word:long,start:long,end:long>>"


def _merged(hits: list[dict]) -> list[dict]:
    """Unions of runs that overlap."""
    out: list[dict] = []
    for h in sorted(hits, key=lambda h: h["word"]):
        if out and h["word"] < out[-1]["to_word"]:
            if h["to_word"] > out[-1]["to_word"]:
                out[-1] |= {"to_word": h["to_word"], "end": h["end"]}
        else:
            out.append(dict(h))
    return out


def benchmark_hits(docs: DataFrame, items: DataFrame, *, window: int = 13) -> DataFrame:
    """The rows packed as ``_row`` and text, with n_words, ``hits`` and ``items``.

    ``hits`` are maximal runs of words inside occurrences of windows (first word,
    word after the last, and their places in the text in code points, end
    exclusive); ``items`` are the sorted ids, as strings, of items with a window
    there. A window is ``window`` consecutive words of an item, or all words of a
    shorter one. Null and empty texts have no words; items without words match
    nothing; an item whose id is null marks words but is not listed. Repeated
    rows are each a row of the result, repeated items count once; empty tables
    give no rows or no hits; other columns pass through in the struct.

    Items are sent to the executors in parts of up to ``ITEM_BYTES``; beyond that
    the documents pass several automata, and the result is the same. A longer
    item is cut into segments that may lie in several parts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "benchmark")
    given = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    asked = given.mapInArrow(_segments(window, ITEM_BYTES // 128), "item string, words binary").distinct()
    asked = scratch.keep(asked, "items")
    total = asked.agg(F.sum(F.length("words") + 32)).first()[0]
    parts = max(1, math.ceil(2 * (total or 0) / ITEM_BYTES))
    rows = packed(docs)
    schema = with_fields(rows, f"n_words long, hits {HITS}, items array<string>")
    out = rows.select("_row", "text", F.lit(0).cast("long").alias("n_words"), F.from_json(F.lit("[]"), HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        if part:
            out = scratch.keep(out, "pass")
        own = asked.where(F.expr(f"pmod(xxhash64(item, words), {parts}) = {part}")).collect()
        shared = spark.sparkContext.broadcast((os.urandom(8), [(r.item, bytes(r.words)) for r in own]))
        out = out.mapInArrow(_scan(shared, window), schema)
    return out


def n_hit(hits=None):
    """Number of words inside ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["to_word"] - h["word"])


def contaminated(percent: int = 5):
    """True if there is a hit and hits are ``percent`` of the words or more."""
    return (n_hit() > 0) & (n_hit() * 100 >= F.col("n_words") * percent)
