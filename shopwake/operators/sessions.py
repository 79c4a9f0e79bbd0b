"""Visits split by inactivity, and the session path report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import times
from .ordered import DEFAULT_SLICE_MS, segments

GAP_MS = 30 * times.MINUTE_MS
MAX_BOUNCE_EVENTS = 2


def visit_events(logs: DataFrame) -> DataFrame:
    """Events of known users with page and action defaults."""
    return logs.filter(
        F.col("user_id").isNotNull() & (F.col("user_id") != "unknown") & F.col("ts").isNotNull()
    ).select(
        "user_id",
        "ts",
        "log_id",
        F.coalesce("log_type", F.lit("unknown")).alias("page"),
        F.coalesce("opa", F.lit("unknown")).alias("action"),
    )


def with_sessions(
    events: DataFrame, gap_ms: int = GAP_MS, slice_ms: int = DEFAULT_SLICE_MS
) -> DataFrame:
    """Add ``session_start`` (epoch ms of the session's first event) and
    ``step``, the event's number inside its session.

    A gap longer than ``gap_ms`` opens a new session; an equal gap does not.
    """
    cut = segments(
        events,
        ["user_id"],
        ["ts", "log_id"],
        ["ts"],
        lambda before, now: now["ts"] - before["ts"] > gap_ms,
        start="_start",
        step="step",
        slice_ms=slice_ms,
    )
    return cut.withColumn("session_start", F.col("_start.ts")).drop("_start")


def _session_id():
    return F.concat_ws("-", "user_id", "session_start").alias("session_id")


def session_metrics(sessions: DataFrame, zone: str = times.DEFAULT_ZONE) -> DataFrame:
    """One row per session, without its path."""
    converted = (F.col("page") == "checkout") | (F.col("action") == "payment")
    per_page = sessions.groupBy("user_id", "session_start", "page").agg(
        F.count("*").alias("n"),
        F.max("ts").alias("last_ts"),
        F.max(converted).alias("converted"),
    )
    duration = F.col("end_time") - F.col("start_time")
    return (
        per_page.groupBy("user_id", "session_start")
        .agg(
            F.count("*").alias("unique_pages"),
            F.sum("n").alias("total_events"),
            F.max("last_ts").alias("end_time"),
            F.max("converted").cast("int").alias("is_conversion"),
        )
        .withColumn("start_time", F.col("session_start"))
        .select(
            times.local_date("session_start", zone).alias("stat_date"),
            "user_id",
            "session_start",
            _session_id(),
            "unique_pages",
            "total_events",
            duration.alias("total_duration"),
            F.coalesce(
                F.floor(duration / F.nullif(F.col("total_events") - 1, F.lit(0))), F.lit(0)
            )
            .cast("bigint")
            .alias("avg_duration"),
            "start_time",
            "end_time",
            (F.col("total_events") <= MAX_BOUNCE_EVENTS).cast("int").alias("is_bounce"),
            "is_conversion",
        )
    )


def session_steps(sessions: DataFrame, zone: str = times.DEFAULT_ZONE) -> DataFrame:
    """The path of every session, one row per step; a session of any length
    needs no list. ``session_id`` leads to the row of the report."""
    return sessions.select(
        "user_id",
        _session_id(),
        "step",
        "page",
        "action",
        times.local_datetime("ts", zone).alias("timestamp"),
    )


REPORT_COLUMNS = [
    "stat_date",
    "user_id",
    "session_id",
    "unique_pages",
    "total_events",
    "total_duration",
    "avg_duration",
    "start_time",
    "end_time",
    "is_bounce",
    "is_conversion",
]


def session_report(sessions: DataFrame, zone: str = times.DEFAULT_ZONE) -> DataFrame:
    """One row per session."""
    return session_metrics(sessions, zone).select(*REPORT_COLUMNS)
