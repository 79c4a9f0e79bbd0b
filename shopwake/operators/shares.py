"""Device reports: first-seen devices, shares, per-user device sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import devices as D, times


def new_devices(logs: DataFrame, zone: str = times.DEFAULT_ZONE) -> DataFrame:
    """One row per device id: its first event with all three names known.

    ``min_by`` keeps one candidate per task before the shuffle, so a device id
    shared by a third of all rows (``unknown``) costs no more than any other.
    """
    named = logs.filter(F.col("ts").isNotNull()).select(
        F.coalesce("userkey", F.lit("unknown")).alias("device_id"),
        "ts",
        "log_id",
        D.platform(F.col("plat"), F.col("brand"), F.col("user_agent")).alias("platform"),
        D.brand_name(F.col("brand")).alias("brand"),
        D.model_name(F.col("device")).alias("model"),
    )
    # Unknown rows take no part through a null position, not through a filter:
    # a filter would work out the three names a second time.
    known = (
        (F.col("platform") != "unknown")
        & (F.col("brand") != "unknown")
        & (F.col("model") != "unknown")
    )
    position = F.when(known, F.struct("ts", "log_id"))
    first = F.min_by(F.struct("ts", "platform", "brand", "model"), position)
    return (
        named.groupBy("device_id")
        .agg(first.alias("first"))
        .filter(F.col("first").isNotNull())
        .select(
            "device_id",
            times.local_date(F.col("first.ts"), zone).alias("stat_date"),
            "first.platform",
            "first.brand",
            "first.model",
        )
    )


def share(devices: DataFrame, within: list[str], name: str) -> DataFrame:
    """Count and percentage of ``name`` inside each ``within`` group.

    The window runs over counted rows, one per name, not over devices.
    """
    total = F.sum("device_count").over(Window.partitionBy(*within))
    percent = (
        F.col("device_count").cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)")
    )
    return (
        devices.groupBy(*within, name)
        .agg(F.count("*").alias("device_count"))
        .withColumn("percentage", F.round(percent, 2).cast("decimal(5,2)"))
    )


def platform_share(devices: DataFrame) -> DataFrame:
    return share(devices, ["stat_date"], "platform")


def brand_share(devices: DataFrame) -> DataFrame:
    return share(devices, ["stat_date", "platform"], "brand")


def model_share(devices: DataFrame) -> DataFrame:
    return share(devices, ["stat_date", "platform", "brand"], "model")


def top_models(shares: DataFrame, n: int = 20) -> DataFrame:
    """The most common models of each date."""
    ranked = Window.partitionBy("stat_date").orderBy(
        F.col("device_count").desc(), "platform", "brand", "model"
    )
    return shares.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


DEVICE_FIELDS = ("brand", "plat", "platv", "softv", "device", "userkey")


def user_devices(logs: DataFrame) -> DataFrame:
    """One row per user and device, where brand and platform name the device
    ignoring case; the first one seen represents it."""
    named = logs.filter(
        F.col("user_id").isNotNull()
        & F.col("brand").isNotNull()
        & F.col("plat").isNotNull()
        & F.col("ts").isNotNull()
    )
    first = F.min_by(F.struct("ts", "log_id", *DEVICE_FIELDS), F.struct("ts", "log_id"))
    return (
        named.groupBy(
            "user_id", F.lower("brand").alias("brand_key"), F.lower("plat").alias("plat_key")
        )
        .agg(first.alias("first"))
        .select("user_id", "brand_key", "plat_key", "first.*")
    )


def device_sets(logs: DataFrame) -> DataFrame:
    """Device list of each user, in order of first sight."""
    return user_devices(logs).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "log_id", *DEVICE_FIELDS))).alias("devices")
    )


def device_distributions(logs: DataFrame) -> DataFrame:
    """Brand and platform counts per user, single or multi device."""
    devices = user_devices(logs)

    def counted(column: str) -> DataFrame:
        entry = F.struct(column, "n")
        return (
            devices.groupBy("user_id", column)
            .agg(F.count("*").cast("int").alias("n"))
            .groupBy("user_id")
            .agg(
                F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(
                    f"{column}_distribution"
                ),
                F.sum("n").alias("total_devices"),
            )
        )

    brands, plats = counted("brand"), counted("plat").drop("total_devices")
    return brands.join(plats, "user_id").withColumn(
        "device_usage_pattern",
        F.when(F.col("total_devices") > 1, "multi_device").otherwise("single_device"),
    )


def device_group_counts(logs: DataFrame) -> DataFrame:
    """How many users have each device group."""
    return (
        user_devices(logs)
        .groupBy(D.group_key(F.col("brand"), F.col("plat")).alias("group_key"))
        .agg(F.count("*").alias("device_count"))
    )
