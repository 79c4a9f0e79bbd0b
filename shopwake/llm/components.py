"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import Scratch


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes of undirected ``edges``; a component is
    named by its least node.

    Every round hangs each node under a smaller one it can reach; the rounds
    grow with the logarithm of the longest path. Only (node, node) pairs move,
    minima are combined before the shuffle, and each round is a written table.
    The minima are written before they are joined, so that adaptive execution
    can split a hub's rows. Self loops and null ends are left out; no edges
    give no rows.
    """
    mark = scratch.mark()
    now = scratch.keep(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before, state = None, _state(now)
    while state != before and state[0]:
        old, mark = mark, scratch.mark()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        scratch.drop(old, mark)
        scratch.drop(mark, scratch.mark() - 1)
        mark = scratch.mark() - 1
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
