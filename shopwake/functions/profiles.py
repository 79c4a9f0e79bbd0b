"""Profile fields computed from one row of facts about a user."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .devices import contains_any

# Bands as (label, threshold), highest first.
MEMBERSHIP = (("premium", 1500), ("regular", 500))
LIFETIME_VALUE = (("high_potential", 1500), ("medium", 500))
USER_VALUE = (("high", 1000), ("medium", 500))
LOGIN_FREQUENCY = (("very_high", 50), ("high", 20), ("medium", 10), ("low", 5))
SEARCH_FREQUENCY = (("very_high", 100), ("high", 50), ("medium", 20), ("low", 5))
BIG_SPENDER, LOYAL_LOGINS, RESEARCH_SEARCHES = 1000, 5, 10
# Words of a comment that tell for whom the shopping is.
FEMALE_WORDS = ("女生", "女士", "女款", "女性")
MALE_WORDS = ("男生", "男士", "男款", "男性")
# Search category -> fragments, first match wins.
SEARCH_CATEGORIES = {
    "pants": ("裤", "pant"),
    "tops": ("上衣", "shirt", "top"),
    "shoes": ("鞋", "shoe"),
    "yoga": ("瑜伽", "yoga"),
    "running": ("跑步", "run"),
    "training": ("训练", "training"),
}
OTHER_CATEGORY = "others"
# Preference -> (fragments, score of its first appearance).
PREFERENCES = {
    "yoga": (("瑜伽", "yoga"), 0.3),
    "running": (("跑步", "run"), 0.3),
    "training": (("训练", "training"), 0.3),
    "pants": (("裤", "pant"), 0.2),
    "tops": (("上衣", "shirt"), 0.2),
}
# Product family -> fragment of the product id.
PRODUCT_FAMILIES = {"AIM": "AIM", "Align™": "Align", "Fast and": "Fast"}
PROFILE_VERSION = "2.0"


def _above(value: Column, bands, otherwise: str) -> Column:
    out = F
    for label, limit in bands:
        out = out.when(value > limit, label)
    return out.otherwise(otherwise)


def _at_least(value: Column, bands, otherwise: str) -> Column:
    out = F
    for label, limit in bands:
        out = out.when(value >= limit, label)
    return out.otherwise(otherwise)


def membership(amount: Column) -> Column:
    return _above(amount, MEMBERSHIP, "new")


def lifetime_value(amount: Column) -> Column:
    return _above(amount, LIFETIME_VALUE, "low")


def user_value(amount: Column) -> Column:
    return _above(amount, USER_VALUE, "low")


def login_frequency(logins: Column) -> Column:
    return _at_least(logins, LOGIN_FREQUENCY, "very_low")


def search_frequency(searches: Column) -> Column:
    return _at_least(searches, SEARCH_FREQUENCY, "very_low")


def engagement_score(logins: Column, searches: Column, devices: Column) -> Column:
    return F.least((logins * 0.3 + searches * 0.5 + devices * 0.2) / 10, F.lit(1.0))


def activity_level(logins: Column, searches: Column) -> Column:
    return (
        F.when((logins >= 10) | (searches >= 20), "high")
        .when((logins >= 5) | (searches >= 10), "medium")
        .otherwise("low")
    )


def archetype(has_history: Column, logins: Column, searches: Column, amount: Column) -> Column:
    return (
        F.when(~has_history, "new_user")
        .when(searches > RESEARCH_SEARCHES, "researcher")
        .when(logins > LOYAL_LOGINS, "loyal_customer")
        .when(amount > BIG_SPENDER, "big_spender")
        .otherwise("casual_shopper")
    )


def shopping_gender(comment: Column, female: str, male: str) -> Column:
    return (
        F.when(contains_any(comment, FEMALE_WORDS), female)
        .when(contains_any(comment, MALE_WORDS), male)
        .otherwise("unknown")
    )


def order_ids(*ids: Column) -> Column:
    return F.array_except(F.array(*ids), F.array(F.lit(None).cast("string")))


def search_category(keyword: Column) -> Column:
    out = F
    for name, fragments in SEARCH_CATEGORIES.items():
        out = out.when(contains_any(keyword, fragments), name)
    return out.otherwise(OTHER_CATEGORY)


def category_counts(keywords: Column) -> Column:
    """Struct of counts by search category over a list of keywords."""
    labels = F.transform(keywords, search_category)

    def counted(name: str) -> Column:
        return F.size(F.filter(labels, lambda c: c == name)).alias(name)

    return F.struct(*[counted(name) for name in (*SEARCH_CATEGORIES, OTHER_CATEGORY)])


def preferences(keywords: Column) -> Column:
    """(categories, score): preferred categories in order of appearance.

    A keyword gives at most one new category; one already known is passed
    over, so a later category may still match the same keyword.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("categories"), F.lit(0.0).alias("score")
    )

    def step(state: Column, word: Column) -> Column:
        def new(name: str) -> Column:
            fragments, _ = PREFERENCES[name]
            fresh = ~F.array_contains(state["categories"], name)
            return contains_any(word, fragments) & fresh

        name, gain = F, F
        for category, (_, score) in PREFERENCES.items():
            name = name.when(new(category), category)
            gain = gain.when(new(category), F.lit(score))
        name = name.otherwise(F.lit(None).cast("string"))
        added = F.array_compact(F.array(name))
        return F.struct(
            F.concat(state["categories"], added).alias("categories"),
            (state["score"] + gain.otherwise(F.lit(0.0))).alias("score"),
        )

    def finish(state: Column) -> Column:
        capped = F.least(F.round(state["score"], 10), F.lit(1.0))
        return F.struct(state["categories"].alias("categories"), capped.alias("score"))

    return F.aggregate(keywords, start, step, finish)


def product_family(product_id: Column) -> Column:
    out = F
    for name, fragment in PRODUCT_FAMILIES.items():
        out = out.when(product_id.contains(fragment), name)
    return out.otherwise(F.lit(None).cast("string"))


def risk(triggered_keyword: Column, ban_days: Column) -> Column:
    sensitive = F.coalesce(triggered_keyword != "", F.lit(False))
    return F.struct(
        sensitive.alias("sensitive_comment_checked"),
        F.array_compact(F.array(F.when(sensitive, triggered_keyword))).alias("triggered_keywords"),
        F.when(sensitive, F.lit(0.5)).otherwise(F.lit(0.1)).alias("risk_score"),
        F.when(sensitive, "medium").otherwise("high").alias("trust_level"),
        F.coalesce(ban_days, F.lit(0)).alias("ban_days"),
    )


def data_sources(**present: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for name, c in present.items()]))


def update_type(has_history: Column) -> Column:
    return F.when(has_history, "batch_daily").otherwise("realtime")
