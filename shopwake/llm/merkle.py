"""Merkle manifest of a dataset: a tree per source, and one over the roots of the sources.

A source's leaves lie in order; every ``FAN`` neighbouring nodes become their hash until one node
remains. The leaves are cut into superblocks of ``BLOCK`` = FAN^h leaves, so a superblock is
a whole subtree. One pass reduces every superblock to its root, and the roots are nodes of the next tier.
From the top tier down, each superblock is then cogrouped with the outer nodes that
its proofs need, the siblings on the way from its root to the top: its task reduces the subtree again, joins
local and outer siblings to a proof for each node and folds what was received with it.

A superblock has at most ``BLOCK`` nodes, whatever the size of its source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
BLOCK = FAN**6
GROUP_NODES = 3 * BLOCK  # nodes of the superblocks that one group holds, on average
PART_ROWS = 10_000  # rows that one task orders, on average

OUTER = "tree string, block long, path string, subroot string, root string"


def leaf(values: list[Column]) -> Column:
    """Hash of the values, each as its length in bytes, a colon and its text, ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def subtree(nodes: list[str], total: int, fan: int, block: int) -> list[list[str]]:
    """All levels of a superblock; it is the whole tree if ``total`` fits in."""
    levels = [nodes]
    steps = round(math.log(block, fan)) if total > block else None
    while len(levels) <= steps if steps is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_hash(below[i : i + fan]) for i in range(0, len(below), fan)])
    return levels


def proof_paths(levels: list[list[str]], outer: str, fan: int) -> list[str]:
    """For each node of the lowest level, its way to the root: per level the siblings to the
    left, ``|``, those to the right, ``;``, and then ``outer``."""
    paths = [outer]
    for nodes in reversed(levels[:-1]):
        def step(i: int, nodes=nodes) -> str:
            run = i - i % fan
            return f"{''.join(nodes[run:i])}|{''.join(nodes[i + 1 : run + fan])};"

        paths = [step(i) + paths[i // fan] for i in range(len(nodes))]
    return paths


def fold(node: str, path: str) -> str:
    """The root that ``node`` gives along its path."""
    for level in path.split(";")[:-1]:
        left, right = level.split("|")
        node = sha256((left + node + right).encode()).hexdigest()
    return node


def proof_digest(path: str) -> str:
    return sha256(path.replace("|", "").replace(";", "").encode()).hexdigest()


def placed(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """Add ``start`` and ``total``: where a row's ``n`` equal leaves begin in their tree, and the
    leaves of the tree. Ranges of rows are ordered side by side and shifted by those before."""
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    cut = scratch.keep(rows.repartitionByRange(parts, F.col("tree"), *order).withColumn("part", F.spark_partition_id()), "ordered")
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("tree", "part").agg(F.sum("n").alias("part_n"))
    by_tree = W.partitionBy("tree")
    shifts = sums.select(
        "tree", "part", F.coalesce(F.sum("part_n").over(by_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
        F.sum("part_n").over(by_tree).alias("total"),
    )
    inside = F.coalesce(F.sum("n").over(before.partitionBy("tree", "part")), F.lit(0))
    return cut.withColumn("inside", inside).join(shifts, ["tree", "part"]).withColumn("start", F.col("inside") + F.col("shift")).drop("part", "inside", "shift")


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """A row per superblock that a row's equal nodes reach into: ``block``, its first position, its
    number of nodes, and the ``bucket`` that holds the superblock."""
    end = F.col("start") + F.col("n")
    blocks = nodes.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    first = F.greatest(F.col("start"), F.col("block") * block)
    return blocks.withColumns({"start": first, "n": F.least(end, (F.col("block") + 1) * block) - first})


def _with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("tree", "block"), F.lit(buckets)))


def _superblocks(frame: pd.DataFrame) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """(tree, block, total, rows in order, each as often as it has copies)."""
    frame.sort_values(["tree", "block", "start"], inplace=True, ignore_index=True)
    trees, blocks = frame["tree"].to_numpy(), frame["block"].to_numpy()
    cuts = np.flatnonzero(np.append(True, (trees[1:] != trees[:-1]) | (blocks[1:] != blocks[:-1])))
    copies = frame["n"].to_numpy()
    for begin, end in zip(cuts, np.append(cuts[1:], len(frame))):
        yield trees[begin], int(blocks[begin]), int(frame["total"].iat[begin]), np.repeat(np.arange(begin, end), copies[begin:end])


def _reducer(fan: int, block: int):
    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, at, total, rows in _superblocks(frame):
            root = subtree(frame["digest"].to_numpy()[rows].tolist(), total, fan, block)[-1][0]
            out.append((tree, at, 1, -(-total // block), root))
        return pd.DataFrame(out, columns=["tree", "start", "n", "total", "digest"])

    return reduce


def _joiner(fan: int, block: int, folding: bool):
    """Cogroup function: nodes of superblocks and their outer rows to paths or proofs of the nodes."""

    def join(frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        ways = {(o.tree, o.block): o for o in outer.itertuples(index=False)}
        out = []
        for tree, at, total, rows in _superblocks(frame) if len(frame) else ():
            way = ways[tree, at]
            nodes = frame["digest"].to_numpy()[rows].tolist()
            paths = proof_paths(subtree(nodes, total, fan, block), way.path, fan)
            labels = frame["label"].to_numpy()[rows]
            if folding:
                for label, node, found, path in zip(labels, nodes, frame["found"].to_numpy()[rows], paths):
                    folded = fold(node if found is None else found, path)
                    out.append((label, node, way.subroot, way.root, proof_digest(path), folded, folded == way.root))
            else:
                for i, (label, node, path) in enumerate(zip(labels, nodes, paths)):
                    out.append((tree, at * block + i, label, node, path, way.subroot, way.root))
        return pd.DataFrame(out, columns=PROOF_COLUMNS if folding else PATH_COLUMNS)

    return join


PATH_COLUMNS = ["tree", "block", "label", "digest", "path", "subroot", "root"]
PATHS = "tree string, block long, label string, digest string, path string, subroot string, root string"
PROOF_COLUMNS = ["label", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
PROOFS = "label string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Forest:
    """Trees over ``nodes`` (tree, start, n, total, digest, label, found), tier by tier."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fan: int, block: int):
        self.scratch, self.fan, self.block = scratch, fan, block
        self.tiers: list[tuple[DataFrame, int]] = []
        self.ends: list[DataFrame] = []  # per tier: roots of the trees that end there
        count = nodes.agg(F.sum("n")).first()[0] or 0
        while count:
            buckets = max(1, math.ceil(count / (GROUP_NODES / BLOCK * block)))
            rows = scratch.keep(_with_bucket(_in_blocks(nodes, block), buckets), "tier")
            self.tiers.append((rows, buckets))
            shape = rows.select("bucket", "tree", "block", "start", "n", "total", "digest")
            up = scratch.keep(shape.groupBy("bucket").applyInPandas(_reducer(fan, block), "tree string, start long, n long, total long, digest string"), "roots")
            self.ends.append(up.where("total = 1").select("tree", "digest"))
            nodes = up.where("total > 1").withColumns({"label": F.lit(None).cast("string"), "found": F.lit(None).cast("string")})
            count = nodes.count()

    def roots(self) -> DataFrame | None:
        every = None
        for end in self.ends:
            every = end if every is None else every.unionByName(end)
        return every

    def joined(self, tops: DataFrame, folding: bool) -> DataFrame:
        """Paths or proofs of the lowest nodes; ``tops`` has (tree, path, subroot, root), the way on from
        each tree's root."""
        outer = None
        for t in reversed(range(len(self.tiers))):
            rows, buckets = self.tiers[t]
            ending = self.ends[t].join(tops, "tree").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
            needed = ending if outer is None else ending.unionByName(outer)
            both = rows.groupBy("bucket").cogroup(_with_bucket(needed, buckets).groupBy("bucket"))
            if t == 0:
                return both.applyInPandas(_joiner(self.fan, self.block, folding), PROOFS if folding else PATHS)
            paths = both.applyInPandas(_joiner(self.fan, self.block, False), PATHS)
            outer = self.scratch.keep(paths.select("tree", "block", "path", "subroot", "root"), "outer")


def merkle_manifest(docs: DataFrame, received: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row per document.

    ``received`` gives, for some fields, what a reader of the dataset found instead: its leaf is folded with
    the original siblings, and the document is verified if that gives the root.

    Sources are ordered by their UTF-8 bytes, null first; leaves by doc_id, null first, then by
    leaf. Rows equal in all fields are equal leaves side by side; they are counted before they are ordered, and
    each gets its own proof. Null values hash as ``-``, empty texts as ``0:``. A very long text is hashed once,
    where it is read, and only its digest moves on. A lone leaf is its source's root, a lone source's root
    the root. An empty table gives no rows. Further columns are ignored, whatever their names.
    """
    if block != fan ** round(math.log(block, fan)):
        raise ValueError("a superblock is a power of the fan-out")
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    columns = [F.col(f"`{c}`") for c in fields]
    other = [(received or {}).get(c, F.col(f"`{c}`")) for c in fields]
    source = F.col("source").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("tree"), "doc_id", leaf(columns).alias("digest"),
        (leaf(other) if received else F.lit(None).cast("string")).alias("found"),
    )
    leaves = leaves.withColumn("found", F.when(F.col("found") != F.col("digest"), F.col("found")))
    counted = scratch.keep(leaves.groupBy("tree", "doc_id", "digest", "found").agg(F.count("*").alias("n")), "leaves")
    ordered = placed(counted, [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], scratch)
    nodes = ordered.select("tree", "start", "n", "total", "digest", F.col("doc_id").cast("string").alias("label"), "found")
    sources = Forest(nodes, scratch, fan, block)
    kind = docs.schema["doc_id"].dataType
    if not sources.tiers:
        return spark.createDataFrame([], PROOFS).withColumn("doc_id", F.col("label").cast(kind)).select("doc_id", *PROOF_COLUMNS[1:])
    subroots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("label"), "digest", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("found"))
    above = Forest(placed(subroots, [F.col("label").asc()], scratch).select("tree", "start", "n", "total", "digest", "label", "found"), scratch, fan, block)
    root = above.roots().select("tree", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    tops = scratch.keep(above.joined(root, False).select(F.col("label").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    return sources.joined(tops, True).select(F.col("label").cast(kind).alias("doc_id"), *PROOF_COLUMNS[1:])
