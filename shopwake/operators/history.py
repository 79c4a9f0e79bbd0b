"""Login and search histories, and statistics per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import logs as L, profiles as P, times
from .joins import recent

LOGINS_SHOWN, SEARCHES_KEPT, KEYWORDS_SHOWN = 20, 100, 50


def login_history(
    logs: DataFrame, shown: int = LOGINS_SHOWN, zone: str = times.DEFAULT_ZONE
) -> DataFrame:
    """Distinct login times per user: count, the newest ones, the last.

    Times are made distinct and ranked before any list is built, so a list
    never has more than ``shown`` entries.
    """
    logins = (
        logs.filter((F.col("log_type") == "login") & F.col("user_id").isNotNull())
        .select("user_id", times.local_datetime("ts", zone).alias("login_time"))
        .distinct()
    )
    counts = logins.groupBy("user_id").agg(F.count("*").alias("login_count"))
    lists = (
        recent(logins, "user_id", ["login_time"], shown)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list("login_time"), asc=False).alias("recent_logins"))
    )
    return counts.join(lists, "user_id").withColumn(
        "last_login", F.get("recent_logins", F.lit(0))
    )


def search_history(
    logs: DataFrame,
    kept: int = SEARCHES_KEPT,
    shown: int = KEYWORDS_SHOWN,
    zone: str = times.DEFAULT_ZONE,
) -> DataFrame:
    """Keywords of each user's last searches, oldest first.

    ``search_keywords`` all of them in order, ``shown_keywords`` the first
    distinct ones; counts are over the kept searches. Categories are worked
    out here, once per user, not per joined row.
    """
    searches = (
        logs.filter((F.col("log_type") == "search") & F.col("user_id").isNotNull())
        .select("user_id", "ts", "log_id", L.clean_keywords(F.col("keywords")).alias("keywords"))
        .filter(F.size("keywords") > 0)
    )
    listed = (
        recent(searches, "user_id", ["ts", "log_id"], kept)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "log_id", "keywords"))).alias("records"))
    )
    keywords = F.flatten(F.transform("records", lambda r: r["keywords"]))
    distinct = F.array_distinct("search_keywords")
    return listed.withColumn("search_keywords", keywords).select(
        "user_id",
        "search_keywords",
        F.slice(distinct, 1, shown).alias("shown_keywords"),
        F.size("search_keywords").alias("search_count"),
        F.size(distinct).alias("unique_search_count"),
        F.size("records").alias("search_sessions"),
        times.local_datetime(F.element_at("records", -1)["ts"], zone).alias("last_search_time"),
        P.category_counts(F.col("search_keywords")).alias("category_analysis"),
        P.preferences(F.col("search_keywords")).alias("preferences"),
    )


def search_categories(logs: DataFrame) -> DataFrame:
    """Searches per user and category, over the whole history."""
    return (
        L.search_keywords(logs.filter(F.col("user_id").isNotNull()))
        .groupBy("user_id", P.search_category(F.col("keyword")).alias("category"))
        .agg(F.count("*").alias("searches"))
    )


def search_counts(logs: DataFrame) -> DataFrame:
    """Searches per user and keyword, over the whole history, as rows."""
    known = L.search_keywords(logs.filter(F.col("user_id").isNotNull()))
    return known.groupBy("user_id", "keyword").agg(F.count("*").alias("searches"))


def search_section(logs: DataFrame) -> DataFrame:
    """The search section of each user with a log, as a struct.

    A user's keywords have no bound, so it counts them and names the
    most frequent (of equals the first by code point); :func:`search_counts` has them all.
    """
    known = logs.filter(F.col("user_id").isNotNull())
    searches = search_counts(known).groupBy("user_id").agg(
        F.sum("searches").alias("total_searched_keywords"),
        F.count("*").alias("different_keywords"),
        F.min_by("keyword", F.struct(-F.col("searches"), "keyword")).alias("top_keyword"),
    )
    return known.select("user_id").distinct().join(searches, "user_id", "left").select(
        "user_id",
        F.struct(
            F.coalesce("total_searched_keywords", F.lit(0)).alias("total_searched_keywords"),
            F.coalesce("different_keywords", F.lit(0)).alias("different_keywords"),
            "top_keyword",
        ).alias("search_analysis"),
    )


def user_statistics(logs: DataFrame, comments: DataFrame) -> DataFrame:
    """Activity, search, comment, order and product sections per user as structs.

    Lists are built from pre-counted rows: one per type, or product family.
    """
    known = logs.filter(F.col("user_id").isNotNull())
    by_type = (
        known.groupBy("user_id", F.coalesce("log_type", F.lit("unknown")).alias("log_type"))
        .agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        .groupBy("user_id")
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("log_type", "n")))
            ).alias("behavior_counts"),
            F.sum("n").alias("total_behaviors"),
            F.min("first").alias("first_activity"),
            F.max("last").alias("last_activity"),
        )
    )
    products = known.groupBy("user_id").agg(
        F.count_distinct("product_id").alias("viewed_products"),
        F.count_distinct("ip").alias("ips"),
    )
    families = (
        known.select("user_id", P.product_family(F.col("product_id")).alias("family"))
        .filter(F.col("family").isNotNull())
        .groupBy("user_id", "family")
        .agg(F.count("*").alias("n"))
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list("family")).alias("product_categories"))
    )
    blocked = F.col("is_sensitive").cast("bigint")
    remarks = comments.groupBy("user_id").agg(
        F.count("*").alias("total_comments"),
        F.sum(blocked).alias("insulting_comments"),
        F.sum(1 - blocked).alias("positive_comments"),
        F.count_distinct("product_id").alias("commented_products"),
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("total_order_amount"),
        F.max("amount").alias("max_order_amount"),
        F.min("amount").alias("min_order_amount"),
        F.count("amount").alias("order_count"),
        F.min("ts").alias("first_comment"),
        F.max("ts").alias("last_comment"),
    )
    joined = (
        by_type.join(products, "user_id")
        .join(families, "user_id", "left")
        .join(search_section(known), "user_id", "left")
        .join(remarks, "user_id", "left")
    )
    total = F.col("total_order_amount")
    return joined.select(
        "user_id",
        F.struct("behavior_counts", "total_behaviors").alias("behavior_analysis"),
        "search_analysis",
        F.struct(
            "total_comments", "insulting_comments", "positive_comments", "commented_products"
        ).alias("comment_analysis"),
        F.struct(
            "total_order_amount",
            (total.cast("double") / F.nullif("order_count", F.lit(0))).alias("average_order_amount"),
            "max_order_amount",
            "min_order_amount",
            "order_count",
        ).alias("order_analysis"),
        F.struct("viewed_products", "product_categories").alias("product_analysis"),
        F.struct("ips").alias("environment_analysis"),
        F.struct("first_activity", "last_activity", "first_comment", "last_comment").alias(
            "time_analysis"
        ),
    )
