"""Addresses to regions: range join on prefixes, city dictionary lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import regions as R

PREFIX = 65536  # addresses per /16 block
# Labels of an unmatched region and characters of no meaning.
UNKNOWN_PROVINCE, UNKNOWN_CITY, CITY_SUFFIX = "未知省", "未知市", "市"
NOISE = "[省市区县]"


def ranges_by_prefix(ranges: DataFrame) -> DataFrame:
    """Each range once per /16 block it touches; at most 65536 blocks exist."""
    blocks = F.sequence(
        F.floor(F.col("start_ip") / PREFIX), F.floor(F.col("end_ip") / PREFIX)
    )
    return ranges.withColumn("ip_block", F.explode(blocks))


def with_region(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Add ``ip_number`` and the region holding it (null when none does).

    The join is on the /16 block and then narrowed to the range, so it is an
    equi-join at any size of the range table; Spark broadcasts it when small.
    """
    numbered = rows.withColumn("ip_number", R.ip_number(F.col(ip))).withColumn(
        "ip_block", F.floor(F.col("ip_number") / PREFIX)
    )
    blocks = ranges_by_prefix(ranges).withColumnRenamed("ip_block", "_block")
    return numbered.join(
        blocks,
        (F.col("ip_block") == F.col("_block"))
        & F.col("ip_number").between(F.col("start_ip"), F.col("end_ip")),
        "left",
    ).drop("ip_block", "_block", "start_ip", "end_ip")


def login_heat_by_ip(logs: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Logins per date and region.

    Counted per (date, address) before the lookup: what is joined shrinks to
    the distinct addresses of each day, however often one address logs in.
    """
    counted = (
        logs.filter(
            (F.col("log_type") == "login") & F.col("ip").isNotNull() & (F.col("ip") != "")
        )
        .groupBy("log_date", "ip")
        .agg(F.count("*").alias("n"))
    )
    province, city, full = R.province_and_city(F.col("region"))
    return (
        with_region(counted, ranges)
        .select(
            "log_date",
            "n",
            province.alias("province"),
            city.alias("city"),
            full.alias("full_region"),
        )
        .groupBy("log_date", *by)
        .agg(F.sum("n").alias("visit_count"))
    )


def dictionary_matches(regions: DataFrame, cities: DataFrame) -> DataFrame:
    """Best dictionary city of each distinct ``region`` text.

    A city matches when its name lies inside the cleaned text or the text
    inside its name; the longest city wins, then the name. Both containments
    are equi-joins on substrings: the texts are short place names, so their
    substrings are few, and no text is compared with every city.
    """
    cleaned = regions.select(
        "region", F.trim(F.regexp_replace("region", NOISE, "")).alias("_text")
    ).filter(F.col("_text") != "")

    def substrings(column: str):
        size = F.char_length(column)
        starts = F.sequence(F.lit(1), size)
        return F.array_distinct(
            F.flatten(
                F.transform(
                    starts,
                    lambda s: F.transform(
                        F.sequence(F.lit(1), size - s + 1),
                        lambda n: F.substr(F.col(column), s, n),
                    ),
                )
            )
        )

    named = cities.filter(F.col("city") != "")
    inside_text = cleaned.withColumn("city", F.explode(substrings("_text"))).join(
        named, "city"
    )
    inside_name = cleaned.join(
        named.withColumn("_text", F.explode(substrings("city"))), "_text"
    )
    columns = ["region", "city", "province"]
    best = F.min_by(F.struct("city", "province"), F.struct(-F.char_length("city"), "city"))
    return (
        inside_text.select(*columns)
        .unionByName(inside_name.select(*columns))
        .groupBy("region")
        .agg(best.alias("best"))
        .select("region", "best.city", "best.province")
    )


def with_dictionary_city(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Add province and city of the ``region`` column by dictionary lookup.

    Apply it to the range table rather than to logs: every log then finds its
    city through the range join it needs anyway.
    """
    found = dictionary_matches(rows.select("region").distinct(), cities)
    found = found.select("region", F.col("province").alias("_p"), F.col("city").alias("_c"))
    return (
        rows.join(found, "region", "left")
        .withColumns(
            {
                "province": F.coalesce("_p", F.lit(UNKNOWN_PROVINCE)),
                "city": F.coalesce(F.concat("_c", F.lit(CITY_SUFFIX)), F.lit(UNKNOWN_CITY)),
            }
        )
        .drop("_p", "_c")
    )
