"""Change feeds: flattening, operation filters, latest state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CONTENT_OPS = ("c", "u", "r")


def flatten(changes: DataFrame) -> DataFrame:
    """Rows carrying an ``after`` image, with table name and operation."""
    return changes.filter(F.col("after").isNotNull()).select(
        "after.*",
        F.concat_ws(".", "source.db", "source.schema", "source.table").alias("table_name"),
        "op",
    )


def content_changes(changes: DataFrame, ops=CONTENT_OPS) -> DataFrame:
    """Inserts, updates and snapshot rows; deletes have no content."""
    return changes.filter(F.col("op").isin(*ops) & F.col("after").isNotNull())


def latest_state(
    changes: DataFrame, keys: list[str], order: list[str], deleted=None
) -> DataFrame:
    """The newest row of each key; keys whose newest change is a delete go.

    The rank filter runs before the shuffle as well, so a key changed over and
    over again sends one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    current = changes.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1")
    gone = (F.col("op") == "d") if deleted is None else deleted
    return current.filter(~gone).drop("_rn")


def merge_state(
    state: DataFrame, changes: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Apply a batch of changes (same columns plus ``op``) to a state table."""
    everything = state.withColumn("op", F.lit("r")).unionByName(changes)
    return latest_state(everything, keys, order).drop("op")


def without_keys(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the delete list."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def change_records(rows: DataFrame, ts_column: str, op: str = "INSERT") -> DataFrame:
    """Text records with the row inside a ``data`` array."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.select(
        F.to_json(
            F.struct(
                F.array(row).alias("data"),
                F.lit(op).alias("type"),
                F.col(ts_column).try_cast("bigint").alias("ts"),
            )
        ).alias("value")
    )


def envelopes(rows: DataFrame, op: str, source: dict[str, str], ts_ms, before=False) -> DataFrame:
    """Change-event envelopes around plain rows."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    empty = F.lit(None).cast(rows.schema)
    return rows.select(
        (row if before else empty).alias("before"),
        (empty if op == "d" else row).alias("after"),
        F.lit(op).alias("op"),
        F.struct(*[F.lit(v).alias(k) for k, v in source.items()]).alias("source"),
        ts_ms.alias("ts_ms"),
    )
