"""Columns of the click log: parsing, defaults, keywords, page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from . import times

# Page types counted by the page report.
PAGE_TYPES = (
    "payment",
    "page_view",
    "click",
    "view",
    "search",
    "login",
    "product_list",
)


def parse_json(df: DataFrame, schema, column: str = "value") -> DataFrame:
    """Text column to typed columns; malformed and empty payloads are dropped.

    Malformed or missing text parses to nulls only, so rows whose fields are
    all null carry nothing and go. ``inline`` makes sure each line is parsed once,
    however many fields are used later.
    """
    parsed = df.select(
        F.inline(F.array(F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})))
    )
    return parsed.dropna(how="all")


def parse_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON log lines to flat typed columns (ts still as sent, fraction cut)."""
    rows = parse_json(df, schemas.LOG_JSON, column)
    return rows.select(
        "log_id",
        "log_type",
        "user_id",
        "order_id",
        "product_id",
        "opa",
        times.whole_epoch("ts").alias("ts"),
        keyword_list("keywords").alias("keywords"),
        F.col("userAgent").alias("user_agent"),
        F.col("gis.ip").alias("ip"),
        "province",
        "city",
        *[F.col(f"device.{n}").alias(n) for n in schemas.DEVICE.fieldNames()],
    )


def dated(df: DataFrame, zone: str = times.DEFAULT_ZONE) -> DataFrame:
    """Normalise ``ts`` to ms and add ``log_date``; rows without ts are dropped."""
    ms = times.epoch_ms("ts")
    return (
        df.filter(F.col("ts").isNotNull())
        .withColumn("ts", ms)
        .withColumn("log_date", times.local_date("ts", zone))
    )


def timed(df: DataFrame, zone: str = times.DEFAULT_ZONE) -> DataFrame:
    """As :func:`dated` plus ``log_time`` (to the second) and ``hour``."""
    return dated(df, zone).withColumns(
        {
            "log_time": times.local_datetime("ts", zone),
            "hour": times.local_hour("ts", zone),
        }
    )


def dated_or_now(df: DataFrame, zone: str = times.DEFAULT_ZONE) -> DataFrame:
    """As :func:`dated`, keeping rows without ts under the processing time."""
    return df.withColumn("ts", times.epoch_ms_or_now("ts")).withColumn(
        "log_date", times.local_date("ts", zone)
    )


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing text becomes ``unknown``, a missing user ``anonymous``."""
    filled = {
        c: F.coalesce(F.col(c), F.lit("unknown"))
        for c in ("log_type", "brand", "plat", "device", "userkey", "opa")
        if c in df.columns
    }
    filled["user_id"] = F.coalesce(F.col("user_id"), F.lit("anonymous"))
    return df.withColumns(filled)


def required(df: DataFrame) -> DataFrame:
    return df.filter(F.col("log_type").isNotNull() & F.col("log_date").isNotNull())


def page_types_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("log_type").isin(*PAGE_TYPES))


def clean_keywords(items: Column) -> Column:
    """Trimmed words without blanks and ``null`` texts."""
    trimmed = F.transform(items, lambda w: F.trim(w))
    return F.filter(trimmed, lambda w: w.isNotNull() & (w != "") & (w != "null"))


def keyword_list(raw: Column | str) -> Column:
    """Keywords sent as a JSON array or as comma-separated text, cleaned."""
    text = F.col(raw) if isinstance(raw, str) else raw
    as_array = F.from_json(text, "array<string>")
    as_split = F.split(text, ",")
    return clean_keywords(
        F.when(F.ltrim(text).startswith("["), as_array).otherwise(as_split)
    )


def search_keywords(df: DataFrame, keywords: str = "keywords") -> DataFrame:
    """One row per keyword of each search log; blanks are dropped."""
    return (
        df.filter(F.col("log_type") == "search")
        .withColumn("keyword", F.explode(clean_keywords(F.col(keywords))))
        .drop(keywords)
    )
