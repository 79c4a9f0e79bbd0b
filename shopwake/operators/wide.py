"""Wide-column cells: one (row key, qualifier, value) per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FAMILY = "info"


def to_cells(rows: DataFrame, row_key: str, family: str = FAMILY) -> DataFrame:
    """One text cell per field; null fields have no cell."""
    fields = [c for c in rows.columns if c != row_key]
    text = rows.select(
        F.col(row_key).cast("string").alias("row_key"),
        *[F.col(c).cast("string").alias(c) for c in fields],
    )
    return (
        text.unpivot("row_key", fields, "qualifier", "value")
        .filter(F.col("value").isNotNull())
        .select("row_key", F.lit(family).alias("family"), "qualifier", "value")
    )


def scan(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """One map of its cells per row key; a scan may stop after ``limit`` keys.

    A row has as many entries as the table has qualifiers, never more.
    """
    chosen = cells
    if limit is not None:
        keys = cells.select("row_key").distinct().orderBy("row_key").limit(limit)
        chosen = cells.join(keys, "row_key", "left_semi")
    entry = F.struct("qualifier", "value")
    return chosen.groupBy("row_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cells")
    )


def row_count(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("row_key").alias("row_count"))


def lookup(cells: DataFrame, key: str) -> DataFrame:
    return cells.filter(F.col("row_key") == key).select("row_key", "qualifier", "value")
