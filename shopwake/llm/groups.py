"""Groups of rows inside sorted Arrow streams, and links inside a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``key``, across batches. One group is held at a
    time, so what makes the keys must bound their rows."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = batch.column(key)
        cuts = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1
        if held and not keys[0].equals(held[-1].column(key)[held[-1].num_rows - 1]):
            yield pa.concat_tables(held)
            held = []
        at = 0
        for cut in cuts:
            part = table.slice(at, cut - at)
            yield pa.concat_tables([*held, part]) if held else part
            held, at = [], int(cut)
        held.append(table.slice(at))
    if held:
        yield pa.concat_tables(held)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` nodes' component under the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def emit(ids: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, counted: np.ndarray) -> pa.RecordBatch:
    """(id, root, links) of the nodes that have a link; ``counted`` says which
    links count here. A root per node stands for all links of the group."""
    n = len(ids)
    root = roots(n, left, right)
    links = np.zeros(n, np.int64)
    np.add.at(links, left[counted], weight[right[counted]])
    np.add.at(links, right[counted], weight[left[counted]])
    some = np.unique(np.concatenate([left, right]))
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], ["id", "root", "links"])


LINKS = "id long, root long, links long"
