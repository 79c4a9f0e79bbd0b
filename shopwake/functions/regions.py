"""Region text to province and city by suffix, and IP addresses as numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffixes of administrative levels and the default label.
PROVINCE_SUFFIX = "省"
AUTONOMOUS_SUFFIX = "自治区"
CITY_SUFFIX = "市"
UNKNOWN = "未知"


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text as a number; anything else gives null: four octets of
    digits, each 0 to 255."""
    octets = F.split(F.trim(ip), r"\.")
    number, valid = F.lit(0).cast("bigint"), F.trim(ip).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for i in range(4):
        octet = F.get(octets, F.lit(i)).try_cast("bigint")
        number = number * 256 + octet
        valid = valid & (octet <= 255)
    return F.when(valid, number)


def _address(region: Column) -> Column:
    """First pipe-separated part that names a province, region or city."""
    named = F.filter(
        F.split(region, r"\|"),
        lambda p: p.contains(PROVINCE_SUFFIX)
        | p.contains(AUTONOMOUS_SUFFIX)
        | p.contains(CITY_SUFFIX),
    )
    return F.get(named, F.lit(0))


def province_and_city(region: Column) -> tuple[Column, Column, Column]:
    """(province, city, full_region) of a region text.

    The province ends at its suffix and the rest is the city; a municipality
    or a province without a tail is its own city. ``full_region`` never
    repeats the name.
    """
    address = _address(region)

    def head(suffix: str) -> Column:
        return F.regexp_extract(address, f"^(.*?{suffix})", 1)

    province = F.coalesce(
        F.when(address.contains(PROVINCE_SUFFIX), head(PROVINCE_SUFFIX))
        .when(address.contains(AUTONOMOUS_SUFFIX), head(AUTONOMOUS_SUFFIX))
        .otherwise(address),
        F.lit(UNKNOWN),
    )
    tail = F.substring(address, F.char_length(province) + 1, F.char_length(address))
    city = F.when(address.isNull(), F.lit(UNKNOWN)).otherwise(
        F.coalesce(F.nullif(tail, F.lit("")), province)
    )
    full = F.when(city == province, province).otherwise(F.concat(province, city))
    return province, city, full
