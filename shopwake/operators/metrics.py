"""Counts over the click log: page views, search words, regions, devices.

All inputs are logs that went through ``functions.logs.dated``. Counting keys
can be as skewed as they like: every ``groupBy`` here combines map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import logs as L, times
from .ordered import ordered_scan


def daily_page_views(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_date", "log_type").agg(F.count("*").alias("pv"))


def windowed_page_views(logs: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Page views in tumbling event-time windows."""
    return (
        logs.groupBy(
            F.window(times.event_time("ts"), width).alias("w"), "log_date", "log_type"
        )
        .agg(F.count("*").alias("pv"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "log_date",
            "log_type",
            "pv",
        )
    )


def page_visit_totals(logs: DataFrame) -> DataFrame:
    """Visits per (date, page) of the listed page types."""
    return (
        L.page_types_only(logs)
        .groupBy(F.col("log_date").alias("ds"), F.col("log_type").alias("page_name"))
        .agg(F.count("*").alias("pv"))
    )


def running_page_visits(logs: DataFrame, tie: str = "log_id") -> DataFrame:
    """Every visit with the count of its (date, page) so far."""
    rows = L.page_types_only(logs).select(
        F.col("log_date").alias("ds"), F.col("log_type").alias("page_name"), "ts", tie
    )
    # A page's whole day is one key here, so slices are minutes.
    return ordered_scan(
        rows,
        ["ds", "page_name"],
        ["ts", tie],
        sums={"pv": F.lit(1).cast("bigint")},
        slice_ms=times.MINUTE_MS,
    )


def search_word_counts(logs: DataFrame) -> DataFrame:
    return (
        L.search_keywords(logs)
        .groupBy("log_date", "keyword")
        .agg(F.count("*").alias("search_count"))
    )


def top_search_words(logs: DataFrame, n: int = 10) -> DataFrame:
    """Most searched words of each date, rank 1 first; ties by word."""
    ranked = Window.partitionBy("log_date").orderBy(
        F.col("search_count").desc(), F.col("keyword")
    )
    return (
        search_word_counts(logs)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= n)
        .select(F.col("log_date").alias("date"), "rank", "keyword", "search_count")
    )


def daily_top_lists(logs: DataFrame, n: int = 10) -> DataFrame:
    """One text per date listing its top words in rank order."""
    entry = F.struct("rank", F.concat_ws(":", "keyword", "search_count").alias("text"))
    return (
        top_search_words(logs, n)
        .groupBy("date")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            "date",
            F.array_join(F.transform("entries", lambda e: e["text"]), ",").alias("top_words"),
        )
        .orderBy("date")
    )


def last_per_date(results: DataFrame, value: str, date: str = "date", ts: str = "ts") -> DataFrame:
    """Repeated outputs of a date collapse to the last one, dates ascending."""
    return (
        results.groupBy(date).agg(F.max_by(value, ts).alias(value)).orderBy(date)
    )


def login_heat(logs: DataFrame, *region: str) -> DataFrame:
    """Logins per date and region columns."""
    return (
        logs.filter(F.col("log_type") == "login")
        .groupBy("log_date", *region)
        .agg(F.count("*").alias("visit_count"))
    )


# Labels that mean a region is not known.
UNKNOWN_REGIONS = ("unknown", "未知省", "未知市")


def known_region_heat(logs: DataFrame) -> DataFrame:
    """All logs per (date, province, city); blanks are unknown and dropped."""

    def label(c: str):
        return F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit("unknown"))

    return (
        logs.select("log_date", label("province").alias("province"), label("city").alias("city"))
        .filter(~F.col("province").isin(*UNKNOWN_REGIONS) & ~F.col("city").isin(*UNKNOWN_REGIONS))
        .groupBy(F.col("log_date").alias("stat_date"), "province", "city")
        .agg(F.count("*").alias("visit_count"))
    )


def top_regions(heat: DataFrame, n: int = 10) -> DataFrame:
    """The busiest regions overall; ties by date and name."""
    return heat.orderBy(
        F.col("visit_count").desc(), "stat_date", "province", "city"
    ).limit(n)


def device_users(logs: DataFrame) -> DataFrame:
    """Distinct device users per (date, platform, brand, platform version)."""
    return (
        logs.filter(F.col("userkey").isNotNull() & F.col("plat").isNotNull())
        .groupBy("log_date", "plat", "brand", "platv")
        .agg(F.count_distinct("userkey").alias("users"))
    )


def device_user_sketches(logs: DataFrame, slice_ms: int = 10 * times.MINUTE_MS, lg_k: int = 14) -> DataFrame:
    """One sketch of the users per device and time slice.

    A sketch has at most 2 ** ``lg_k`` bytes, however many users it has seen; those of
    any slices can be merged, so a table of them answers windows of every width.
    """
    slice_start = F.col("ts") - F.pmod(F.col("ts"), F.lit(slice_ms))
    return (
        logs.filter(F.col("userkey").isNotNull() & F.col("plat").isNotNull())
        .groupBy("log_date", slice_start.alias("slice_ms"), "plat", "brand", "platv")
        .agg(F.hll_sketch_agg("userkey", lg_k).alias("sketch"))
    )


def sketched_users(sketches: DataFrame, *keys) -> DataFrame:
    """Estimated users per ``keys``, from the slices that fall under each."""
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("users", F.hll_sketch_estimate("sketch")).drop("sketch")


# Last login hour -> period label, ascending.
PERIODS = {5: "凌晨(1-5)", 12: "早上(6-12)", 14: "中午(12-14)", 18: "下午(14-18)"}
LATE_PERIOD, NO_PERIOD, NO_LOGIN = "晚上(18-24)", "未知", "无登录"


def day_period(last_hour):
    label = F.when(last_hour.isNull(), NO_PERIOD)
    for upper, name in PERIODS.items():
        label = label.when(last_hour <= upper, name)
    return label.otherwise(LATE_PERIOD)


def user_portraits(logs: DataFrame, width: str | None = "30 seconds") -> DataFrame:
    """Login days, hours and behaviour flags per user and window.

    Two levels: (user, window, date) first, so that the list of dates is built
    from one row per date. ``width=None`` covers the whole history.
    """
    keys = ["user_id"]
    rows = logs.filter(F.col("user_id").isNotNull())
    if width:
        rows = rows.withColumn("window_end", F.window(times.event_time("ts"), width)["end"])
        keys.append("window_end")
    login = F.col("log_type") == "login"
    other = ~F.coalesce(F.col("log_type").isin("login", "payment", "search"), F.lit(False))

    def seen(condition, name):
        return F.max(F.coalesce(condition, F.lit(False))).alias(name)

    daily = rows.groupBy(*keys, "log_date").agg(
        seen(login, "has_login"),
        seen(F.col("log_type") == "payment", "has_payment"),
        seen(F.col("log_type") == "search", "has_search"),
        seen(other, "has_browse"),
        F.min(F.when(login, F.col("hour"))).alias("first_hour"),
        F.max(F.when(login, F.col("hour"))).alias("last_hour"),
    )
    login_day = F.when(F.col("has_login"), F.col("log_date"))
    result = daily.groupBy(*keys).agg(
        F.count(login_day).alias("login_days"),
        F.array_join(F.array_sort(F.collect_list(login_day)), ",").alias("login_dates"),
        F.max("has_payment").alias("has_payment"),
        F.max("has_search").alias("has_search"),
        F.max("has_browse").alias("has_browse"),
        F.min("first_hour").alias("first_hour"),
        F.max("last_hour").alias("last_hour"),
    )
    hours = F.format_string("%d点-%d点", "first_hour", "last_hour")
    return result.withColumns(
        {
            "login_time_range": F.when(F.col("first_hour").isNull(), NO_LOGIN).otherwise(hours),
            "time_period": day_period(F.col("last_hour")),
        }
    ).drop("first_hour", "last_hour")
