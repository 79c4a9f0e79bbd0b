"""Words of UTF-8 texts as numpy arrays, whole Arrow batches at a time.

A word is a run of ASCII letters and digits and of bytes above 0x7F, ASCII
letters lower-cased: the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z. Null counts as empty; words never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20  # bytes hashed at once; bounds the work arrays

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
LOWER = _low
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that close inputs spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15))


_BYTE = np.where(IS_WORD[LOWER], stream(1, 256)[LOWER], np.uint64(0))
_P = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 1)
        _POWERS[:] = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column on end, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a flat column: hash, first byte, end byte; ``at`` has the n + 1
    places where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        hashes, starts, ends = [], [], []
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        at = 0
        while at < n:
            to = min(at + SEGMENT, n)
            while to < n and IS_WORD[LOWER[data[to - 1]]] and not edge[to]:
                to += 1
            part = data[at:to]
            inside = IS_WORD[LOWER[part]]
            first = inside.copy()
            first[1:] &= ~inside[:-1] | edge[at + 1 : to]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | edge[at + 1 : to]
            begin = np.flatnonzero(first)
            if len(begin):
                up, down = _powers(len(part))
                value = np.add.reduceat(_BYTE[part] * up[: len(part)], begin) * down[begin]
                hashes.append(mix(value))
                starts.append(begin + at)
                ends.append(np.flatnonzero(last) + at + 1)
            at = to
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.at = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


_SHINGLE = stream(2, 64) | np.uint64(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words and the n + 1 places where each text's
    begin; a text of fewer words, but not none, has one shingle of them all."""
    h, counts = words.hash, words.counts
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n_out)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    begins = np.repeat(words.at[:-1] - at[:-1], n_out) + np.arange(at[-1])
    total = np.zeros(at[-1], np.uint64)
    left = np.repeat(words.at[1:], n_out) - begins  # words there are from here on
    for j in range(k):
        total += np.where(left > j, padded[begins + j] * _SHINGLE[j] + np.uint64(j + 1), np.uint64(0))
    return mix(total), at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(o[keep], minlength=len(at) - 1))]).astype(np.int64)


def list_array(values: np.ndarray, at: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))
