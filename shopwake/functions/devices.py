"""Device platform, brand and model normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Canonical name -> lower-case fragments, first match wins.
PLATFORM_BY_PLATFORM_TEXT = {
    "Android": ("android", "adr"),
    "iOS": ("ios", "iphone"),
    "Windows": ("windows",),
    "macOS": ("mac",),
    "Linux": ("linux",),
}
PLATFORM_BY_BRAND = {
    "Android": ("huawei", "honor", "xiaomi", "mi ", "oppo", "vivo", "samsung"),
    "iOS": ("apple", "iphone"),
}
PLATFORM_BY_USER_AGENT = {
    "Android": ("android", "adr"),
    "iOS": ("iphone", "ipad", "ios"),
    "Windows": ("windows",),
    "macOS": ("mac",),
    "Linux": ("linux",),
}
BRAND_NAMES = {
    "华为": ("huawei", "honor"),
    "小米": ("xiaomi", "mi "),
    "OPPO": ("oppo",),
    "vivo": ("vivo",),
    "三星": ("samsung",),
    "苹果": ("apple", "iphone"),
    "一加": ("oneplus",),
    "魅族": ("meizu",),
    "诺基亚": ("nokia",),
    "索尼": ("sony",),
    "联想": ("lenovo",),
}


def contains_any(text: Column, fragments) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(f) for f in fragments])


def first_match(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Name of the first entry with a fragment inside ``text``, else null."""
    out = F
    for name, fragments in table.items():
        out = out.when(contains_any(text, fragments), name)
    return out


def platform(plat: Column, brand: Column, user_agent: Column) -> Column:
    """Platform from its own text, else the brand, else the user agent."""
    return F.coalesce(
        first_match(F.lower(plat), PLATFORM_BY_PLATFORM_TEXT),
        first_match(F.lower(brand), PLATFORM_BY_BRAND),
        first_match(F.lower(user_agent), PLATFORM_BY_USER_AGENT),
        F.lit("unknown"),
    )


def brand_name(brand: Column) -> Column:
    """Canonical brand; an unlisted brand stays as sent, a blank is unknown."""
    known = first_match(F.trim(F.lower(brand)), BRAND_NAMES)
    return F.when(
        brand.isNull() | (F.trim(brand) == ""), F.lit("unknown")
    ).otherwise(F.coalesce(known, brand))


def model_name(model: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(model), F.lit("")), F.lit("unknown"))


def group_key(brand: Column, plat: Column) -> Column:
    """Two devices are the same when brand and platform match ignoring case."""
    return F.concat_ws(
        "_",
        F.coalesce(F.lower(brand), F.lit("unknown")),
        F.coalesce(F.lower(plat), F.lit("unknown")),
    )
