"""Sales over cumulative windows: totals and leading ids per window.

A cumulative window of a day starts at midnight and ends at every step; a sale
belongs to each window of its day that ends after it. Sales are first summed
per step, so what follows handles at most one row per (step, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import times

STEP_MS = 10 * times.MINUTE_MS
SPAN_MS = times.DAY_MS
READ_OPS = ("r", "+I", "+U")
MONEY = "decimal(18,2)"


def sales_rows(
    sales: DataFrame, day: str | None = None, ops: tuple[str, ...] | None = READ_OPS
) -> DataFrame:
    """Sales with event time, without removals, of one day or of all days."""
    rows = sales.withColumn(
        "event_ms", F.unix_millis(times.sales_event_time("ts", "insert_time"))
    ).filter(F.col("event_ms").isNotNull())
    if ops:
        rows = rows.filter(F.col("op").isin(*ops))
    if day:
        rows = rows.filter(utc_day("event_ms") == day)
    return rows.withColumn("amount", F.col("total_amount").cast(MONEY))


def utc_day(ms: str) -> Column:
    return times.local_date(ms, "UTC")


def _floor_to(ms: Column, width: int) -> Column:
    return ms - F.pmod(ms, F.lit(width))


def step_sums(
    sales: DataFrame, *ids: str, step_ms: int = STEP_MS, span_ms: int = SPAN_MS
) -> DataFrame:
    """Amount per (day, step end[, id])."""
    at = F.col("event_ms")
    return sales.groupBy(
        _floor_to(at, span_ms).alias("window_start"),
        (_floor_to(at, step_ms) + step_ms).alias("step_end"),
        *ids,
    ).agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))


def window_ends(sums: DataFrame, step_ms: int = STEP_MS, span_ms: int = SPAN_MS) -> DataFrame:
    """Every window of each day, from its first sale to midnight.

    Windows without a sale in their last step exist too.
    """
    return sums.groupBy("window_start").agg(F.min("step_end").alias("first")).select(
        "window_start",
        F.explode(
            F.sequence(F.col("first"), F.col("window_start") + span_ms, F.lit(step_ms))
        ).alias("window_end"),
    )


def cumulative_totals(
    sales: DataFrame, step_ms: int = STEP_MS, span_ms: int = SPAN_MS
) -> DataFrame:
    """(window_start, window_end, gmv) for every cumulative window."""
    sums = step_sums(sales, step_ms=step_ms, span_ms=span_ms)
    so_far = (
        Window.partitionBy("window_start")
        .orderBy("window_end")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One row per step of a day: the window sees at most span/step rows a day.
    return (
        window_ends(sums, step_ms, span_ms)
        .join(
            sums.withColumnRenamed("step_end", "window_end"),
            ["window_start", "window_end"],
            "left",
        )
        .withColumn("gmv", F.sum("amount").over(so_far).cast("decimal(38,2)"))
        .drop("amount")
    )


def _id_totals(sums: DataFrame, id_col: str) -> DataFrame:
    """Running amount of each id at the steps where it changes."""
    so_far = (
        Window.partitionBy("window_start", id_col)
        .orderBy("step_end")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return sums.withColumn("total", F.sum("amount").over(so_far).cast("decimal(38,2)"))


def _rank(id_col: str, *partition: str):
    return Window.partitionBy(*partition).orderBy(F.col("total").desc(), F.col(id_col))


def cumulative_sums_by(
    sales: DataFrame, id_col: str, step_ms: int = STEP_MS, span_ms: int = SPAN_MS
) -> DataFrame:
    """Sum of every id in every window it has entered, as a table."""
    sums = step_sums(sales, id_col, step_ms=step_ms, span_ms=span_ms)
    return _spread(_id_totals(sums, id_col), id_col, step_ms, span_ms)


def _spread(totals: DataFrame, id_col: str, step_ms: int, span_ms: int) -> DataFrame:
    """Repeat each running total for the windows until the id's next change."""
    ahead = Window.partitionBy("window_start", id_col).orderBy("step_end")
    day_end = F.col("window_start") + span_ms
    last = F.coalesce(F.lead("step_end").over(ahead) - step_ms, day_end)
    return totals.withColumn("_last", last).select(
        "window_start",
        F.explode(F.sequence("step_end", "_last", F.lit(step_ms))).alias("window_end"),
        id_col,
        "total",
    )


def cumulative_top(
    sales: DataFrame,
    id_col: str,
    n: int = 5,
    step_ms: int = STEP_MS,
    span_ms: int = SPAN_MS,
) -> DataFrame:
    """The ``n`` leading ids of every cumulative window, ties by id.

    While amounts only grow, an id outside the top n of the ids that changed
    in its own step can never lead later without changing again: everybody
    else only gains. So n candidates per step are enough, and only they are
    repeated over the later windows. An id with a negative step sum on a day
    does not have that property and keeps all its rows of the day; the rule
    holds among the others, and the leaders are among both.
    """
    sums = step_sums(sales, id_col, step_ms=step_ms, span_ms=span_ms)
    totals = _id_totals(sums, id_col)
    own = ["window_start", id_col]
    shrinking = sums.filter(F.col("amount") < 0).select(*own).distinct()
    growing = totals.join(shrinking, own, "left_anti")
    candidates = (
        growing.withColumn("_r", F.row_number().over(_rank(id_col, "window_start", "step_end")))
        .filter(F.col("_r") <= n)
        .drop("_r")
    )
    kept = candidates.unionByName(totals.join(shrinking, own, "left_semi"))
    return (
        _spread(kept, id_col, step_ms, span_ms)
        .withColumn("rn", F.row_number().over(_rank(id_col, "window_start", "window_end")))
        .filter(F.col("rn") <= n)
    )


def listed(top: DataFrame, id_col: str, name: str) -> DataFrame:
    """Ids of each window joined with commas, in rank order."""
    return top.groupBy("window_start", "window_end").agg(
        F.expr(f"listagg({id_col}, ',') WITHIN GROUP (ORDER BY rn)").alias(name)
    )


def gmv_topn(
    sales: DataFrame, n: int = 5, step_ms: int = STEP_MS, span_ms: int = SPAN_MS
) -> DataFrame:
    """Total and leading ids and products of every cumulative window."""
    keys = ["window_start", "window_end"]
    options = {"n": n, "step_ms": step_ms, "span_ms": span_ms}
    ids = listed(cumulative_top(sales, "id", **options), "id", "top5_ids")
    products = listed(
        cumulative_top(sales, "product_id", **options), "product_id", "top5_product_ids"
    )
    rows = (
        cumulative_totals(sales, step_ms, span_ms)
        .join(ids, keys, "left")
        .join(products, keys, "left")
    )
    return rows.select(
        utc_day("window_start").alias("order_date"),
        times.local_time("window_start", "UTC").alias("window_start"),
        times.local_time("window_end", "UTC").alias("window_end"),
        "gmv",
        F.coalesce("top5_ids", F.lit("")).alias("top5_ids"),
        F.coalesce("top5_product_ids", F.lit("")).alias("top5_product_ids"),
    )


def report_rows(gmv: DataFrame) -> DataFrame:
    """Column names of the report table, with its day partition column."""
    return gmv.select(
        "order_date",
        F.col("window_start").alias("window_start_time"),
        F.col("window_end").alias("window_end_time"),
        F.col("gmv").alias("gmv_total"),
        F.col("top5_ids").alias("top_user_ids"),
        F.col("top5_product_ids").alias("top_product_ids"),
        F.to_date("window_end").alias("ds"),
    )
