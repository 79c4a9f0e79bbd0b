"""Moderation history of users: sensitive counts and consumption bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import DEFAULT_SLICE_MS, Slices

# Fixed values: (band, greatest amount above, mean of two amounts from).
BANDS = (("HIGH", 10000, 4000), ("MEDIUM", 8000, 3000))
LOWEST_BAND = "LOW"


def consumption_level(last_two: Column) -> Column:
    """Band of a (latest, before) pair of amounts."""
    latest, before = last_two["latest"], last_two["before"]
    greatest = F.greatest(latest, before)
    mean = (latest + before) / 2
    band = F
    for name, above, mean_from in BANDS:
        band = band.when((greatest > above) | (mean >= mean_from), name)
    return band.otherwise(LOWEST_BAND)


def with_history(
    comments: DataFrame,
    key: str,
    user: str = "user_id",
    slice_ms: int = DEFAULT_SLICE_MS,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Add per user and in time order

    ``sensitive_count``   sensitive comments so far
    ``recent_max`` / ``recent_mean``  over the last two known amounts
    ``consumption_level`` the band of those

    A comment without an amount keeps the pair of the one before it. ``earlier``
    has what came before these comments, as :func:`carried` gives it; then
    ``last_two``, the pair itself, is added too.
    """
    s = Slices(comments, [user], ["ts", key], slice_ms)
    amount = F.col("amount")

    def pair(latest, before):
        return F.struct(latest.alias("latest"), before.alias("before"))

    local = [
        {
            "_known": F.last("amount", ignorenulls=True).over(s.until_previous),
            "_hits": F.sum(F.col("is_sensitive").cast("bigint")).over(s.so_far),
        },
        {"_own": F.when(amount.isNotNull(), pair(amount, F.col("_known")))},
        {"_l_two": F.last("_own", ignorenulls=True).over(s.so_far)},
    ]
    summary = {
        "_e_two": F.max_by("_own", F.when(amount.isNotNull(), s.position)),
        "_e_hits": F.sum(F.col("is_sensitive").cast("bigint")),
    }
    carry = [
        {
            "_c_hits": F.sum("_e_hits").over(s.earlier),
            "_c_known": F.last(F.col("_e_two.latest"), ignorenulls=True).over(s.earlier),
        },
        {
            "_end": F.when(
                F.col("_e_two").isNotNull(),
                pair(F.col("_e_two.latest"), F.coalesce("_e_two.before", "_c_known")),
            )
        },
        {"_c_two": F.last("_end", ignorenulls=True).over(s.earlier)},
    ]
    own = F.when(
        F.col("_l_two").isNotNull(),
        pair(F.col("_l_two.latest"), F.coalesce("_l_two.before", "_c_known")),
    )
    two = F.coalesce(own, F.col("_c_two"))
    scanned = s.scan(
        local,
        summary,
        carry,
        {
            "sensitive_count": F.col("_hits") + F.coalesce("_c_hits", F.lit(0)),
            "_two": two,
        },
    )
    if earlier is not None:
        past = earlier.select(F.col(user).alias("_user"), F.col("sensitive_count").alias("_past"), F.col("last_two").alias("_past_two"))
        scanned = scanned.join(past, F.col(user).eqNullSafe(F.col("_user")), "left")
        widened = pair(F.col("_two.latest"), F.coalesce("_two.before", "_past_two.latest"))
        scanned = scanned.withColumns(
            {
                "sensitive_count": F.col("sensitive_count") + F.coalesce("_past", F.lit(0)),
                "_two": F.when(F.col("_two").isNotNull(), widened).otherwise(F.col("_past_two")),
            }
        ).drop("_user", "_past", "_past_two")
        scanned = scanned.withColumn("last_two", F.col("_two"))
    latest, before = F.col("_two.latest"), F.col("_two.before")
    return scanned.withColumns(
        {
            "recent_max": F.greatest(latest, before),
            "recent_mean": F.when(before.isNull(), latest).otherwise((latest + before) / 2),
            "consumption_level": consumption_level(F.col("_two")),
        }
    ).drop("_two")


def carried(history: DataFrame, key: str, user: str = "user_id") -> DataFrame:
    """(user, sensitive_count, last_two) after the last comment of each user."""
    newest = F.max_by(F.struct("sensitive_count", "last_two"), F.struct("ts", key))
    return history.groupBy(user).agg(newest.alias("_end")).select(user, "_end.*")
