"""Page-to-page transitions of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import times
from .ordered import DEFAULT_SLICE_MS, ordered_scan


def transitions(
    logs: DataFrame,
    tie: str = "log_id",
    zone: str = times.DEFAULT_ZONE,
    slice_ms: int = DEFAULT_SLICE_MS,
) -> DataFrame:
    """Consecutive events of a user with different types, dated by the second."""
    rows = logs.filter(F.col("user_id").isNotNull()).select(
        "user_id", "ts", tie, "log_type"
    )
    scanned = ordered_scan(
        rows, ["user_id"], ["ts", tie], previous=["log_type"], slice_ms=slice_ms
    )
    return scanned.filter(F.col("prev_log_type") != F.col("log_type")).select(
        "user_id",
        "ts",
        times.local_date("ts", zone).alias("stat_date"),
        F.concat_ws("→", "prev_log_type", "log_type").alias("path_sequence"),
    )


def transition_counts(logs: DataFrame, **options) -> DataFrame:
    return (
        transitions(logs, **options)
        .groupBy("stat_date", "path_sequence")
        .agg(F.count("*").alias("transition_count"))
    )
