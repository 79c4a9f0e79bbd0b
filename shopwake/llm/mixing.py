"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are laid end to end in a shuffled order, and this
stream of words is cut into blocks of equal length. The mix is a row of slots,
one block each. Slot i has the golden-ratio lattice point i * g mod n (g near
n / phi and coprime to n); the cumulative weights cut the points into one
interval per source, so a source holds its exact number of slots, evenly spread
at every length. The r-th slot of a source takes its r-th block.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PART_ROWS = 10_000  # rows or slots that one window task sees, on average


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Rank of each source by code point, null last, from 0. Ranges of sources
    are ranked side by side and shifted by the sizes of the ranges before."""
    order = [F.col("source").asc_nulls_last()]
    n = sources.count()
    ranges = max(1, math.ceil(n / PART_ROWS))
    cut = scratch.keep(sources.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "sources")
    shift = cut.groupBy("_range").count().withColumn(
        "_shift", F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    )
    rank = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1 + F.coalesce("_shift", F.lit(0))
    return cut.join(F.broadcast(shift.drop("count")), "_range").withColumn("rank", rank).drop("_range", "_shift")


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes dealt by
    weight, no target above ``repeats`` times its source; what is above goes to
    the others by weight until none is above."""
    ranked = source_order(sizes, scratch)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.keep(ranked.withColumn("weight", weight), "ranked")
    most = F.col("source_size") * F.lit(float(repeats))
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = min(share, repeats) * float(total[0] or 0)
    unit, before = wanted / total[1] if total[1] else 0.0, -1.0
    while unit != before:  # the stopped sources only grow in number
        stopped = F.col("weight") * F.lit(unit) >= most
        row = ranked.agg(
            F.sum(F.when(stopped, most).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).first()
        before, unit = unit, (wanted - row[0]) / row[1] if row[1] else unit
    return ranked.withColumn("target", F.least(most, F.col("weight") * F.lit(unit)))


def _step(n: int) -> int:
    g = max(1, round(n * (math.sqrt(5) - 1) / 2))
    while math.gcd(g, n) != 1:
        g += 1
    return g


def schedule(plan: DataFrame, scratch: Scratch, block_words: int) -> DataFrame:
    """(source, block, slot): which slot of the mix each block of each source
    has. ``plan`` has source, target and rank."""
    slots = scratch.keep(plan.withColumn("n_slots", F.ceil(F.floor("target") / block_words).cast("long")), "plan")
    n = slots.agg(F.sum("n_slots")).first()[0] or 0
    if not n:
        return slots.select("source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot")).limit(0)
    back = pow(_step(n), -1, n)
    # Where a source's interval begins: its weight and those of all before it.
    ranges = F.floor(F.col("rank") / PART_ROWS)
    tops = slots.groupBy(ranges.alias("_range")).agg(F.sum("n_slots").alias("_n"))
    tops = tops.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_top"))
    inner = F.sum("n_slots").over(W.partitionBy("_range").orderBy("rank")) - F.col("n_slots")
    begins = slots.withColumn("_range", ranges).withColumn("_in", inner).join(F.broadcast(tops), "_range")
    pieces = begins.where("n_slots > 0").select(
        "source", (F.col("_top") + F.col("_in")).alias("_low"), "n_slots",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / PART_ROWS))).alias("_piece"),
    )
    first = F.col("_low") + F.col("_piece") * PART_ROWS
    last = F.col("_low") + F.least((F.col("_piece") + 1) * PART_ROWS, F.col("n_slots")) - 1
    points = pieces.repartition(F.col("source"), F.col("_piece")).select("source", F.explode(F.sequence(first, last)).alias("_point"))
    wide = F.col("_point").cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)")
    dealt = points.select("source", (wide % F.lit(n).cast("decimal(19,0)")).cast("long").alias("slot"))
    # Rank per source: inside runs of slots, shifted by the counts of earlier runs.
    dealt = scratch.keep(dealt.withColumn("_run", F.floor(F.col("slot") / PART_ROWS)), "slots")
    runs = dealt.groupBy("source", "_run").count()
    shift = F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = scratch.keep(runs.select(F.col("source").alias("_s"), F.col("_run").alias("_r"), shift.alias("_shift")), "runs")
    rank = F.row_number().over(W.partitionBy("source", "_run").orderBy("slot")) - 1
    return (
        dealt.withColumn("_rank", rank)
        .join(runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r")))
        .select("source", (F.col("_rank") + F.col("_shift")).cast("long").alias("block"), "slot")
    )


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    block_words: int = 1024,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, text_hash,
    taken and ``pieces``, an array of (slot, from_word, to_word): the words of the
    document that each slot holds.

    A document's words are taken ``repeats`` times at most, since a target ends
    at that many times its source. The order of a source is by md5 of seed and
    doc_id, so reruns agree; equal doc_ids are ordered by size, then text hash, and
    rows equal in all are interchangeable. Null or empty texts have size 0 and no pieces;
    null is a source of its own, the last; an empty table gives no rows. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = scratch.keep(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), key.alias("_key"), F.xxhash64("text").alias("_tie")), "sizes"
    )
    plan = scratch.keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, share, repeats), "targets")
    # Offsets in the shuffled order: inside parts of it, shifted by the parts before.
    n = rows.count()
    digits = min(8, max(0, math.ceil(math.log(max(1, n / PART_ROWS), 16))))
    rows = rows.withColumn("_part", F.substring("_key", 1, digits))
    parts = rows.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.keep(parts.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), before.alias("_before")), "parts")
    inside = W.partitionBy("source", "_part").orderBy("_key", "size", "_tie")
    placed = (
        rows.withColumn("_row", F.row_number().over(inside))
        .withColumn("_in", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        .withColumn("_from", F.col("_in") + F.col("_before"))
        .drop("_s", "_p", "_in", "_before")
    )
    by_source = plan.select(F.col("source").alias("_s"), "source_size", "target")
    placed = scratch.keep(placed.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "placed")
    slots = schedule(plan, scratch, block_words)
    # A document lies once in every pass over its source; each pass ends at the target.
    passes = placed.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    begin = F.col("_from") + F.col("_pass") * F.col("source_size")
    end = F.least(begin + F.col("size"), F.floor("target"))
    passes = passes.withColumn("_begin", begin).withColumn("_end", end)
    blocks = F.when(
        F.col("_end") > F.col("_begin"),
        F.sequence(F.floor(F.col("_begin") / block_words), F.floor((F.col("_end") - 1) / block_words)),
    )
    cut = passes.where("_end > _begin").withColumn("block", F.explode(blocks))
    held = cut.join(
        slots.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "slot"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")),
    )
    low = F.greatest("_begin", F.col("block") * block_words) - F.col("_begin")
    high = F.least("_end", (F.col("block") + 1) * block_words) - F.col("_begin")
    row = ["source", "_part", "_row"]
    taken = held.groupBy(*row).agg(
        F.sum(high - low).alias("taken"), F.collect_list(F.struct("slot", low.alias("from_word"), high.alias("to_word"))).alias("pieces")
    )
    taken = taken.select(*(F.col(c).alias(f"t{c}") for c in row), "taken", "pieces")
    same = F.col("source").eqNullSafe(F.col("tsource")) & (F.col("_part") == F.col("t_part")) & (F.col("_row") == F.col("t_row"))
    none = F.array().cast("array<struct<slot:bigint,from_word:bigint,to_word:bigint>>")
    return placed.join(taken, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.col("_tie").alias("text_hash"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", none).alias("pieces"),
    )
