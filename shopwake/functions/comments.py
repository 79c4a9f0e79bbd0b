"""Comment columns: repair, level, amounts, moderation result."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from .devices import contains_any

# Words of the two report levels; p1 is looked up first.
P1_WORDS = (
    "政治", "反动", "色情", "黄赌毒", "毒品", "颠覆", "港独", "台独",
    "反党", "猥亵", "建国", "台湾", "情妇",
)
P2_WORDS = (
    "傻逼", "妈的", "猪", "垃圾", "滚", "捅我", "狗", "废物", "你爹",
    "智障", "sb", "操", "艹", "对线", "地狱笑话",
    "东北人", "河南人", "山东人", "穷鬼",
)
# Price patterns, tried in this order.
AMOUNT_PATTERNS = (
    r"(\d{1,10}[.,]?\d{0,2})\s*(元|块|人民币|RMB|¥)",
    r"(\d{1,10}[.,]?\d{0,2})\s*元",
    r"(?:价格|售价|价值|花费|支付|买了|买来|花了)\s*(\d{1,10}[.,]?\d{0,2})",
    r"(\d{1,10}[.,]?\d{0,2})\s*(?:价格|售价|价值)",
    r"\b(\d{3,5}[.,]?\d{0,2})\b",
)
# What counts when no pattern does, and which amounts do.
AMOUNT_RUNS = r"\b(\d{3,})\b"
AMOUNT_RANGE = (100, 100000)
AMOUNT_NUMBER = r"^-?\d+(\.\d+)?$"
# Moderation outcome by level.
BAN_DAYS = {"P0": 365, "P1": 60, "P2": 0}
ACTIONS = {"P0": "BAN_365D_AND_SHIELD", "P1": "BAN_60D_AND_SHIELD", "P2": "NONE"}
MASKS = {"P0": "***", "P1": "**", "P2": "*"}
WEIGHTS = {"P0": 3, "P1": 2, "P2": 1}
CLEAN = "CLEAN"


GBK = "decode(encode({0}, 'ISO-8859-1'), 'GBK')"


def gbk_text(column: str) -> Column:
    """Text whose Latin-1 bytes are really GBK, re-read; null stays null. The
    session allows the character set (``spark.sql.legacy.javaCharsets``)."""
    return F.expr(GBK.format(column))


def lookup(key: Column, table: dict, default) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def report_level(comment: Column) -> Column:
    """p1, p2 or p3 by the words inside a comment; a missing comment is p3."""
    text = F.lower(comment)
    return (
        F.when(contains_any(text, P1_WORDS), "p1")
        .when(contains_any(text, P2_WORDS), "p2")
        .otherwise("p3")
    )


def register_sql_functions(spark: SparkSession) -> None:
    """``gbk_decode`` and ``comment_level`` for use inside SQL text."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION gbk_decode(c STRING) RETURNS STRING RETURN {GBK.format('c')}"
    )

    def any_of(words):
        return " OR ".join(f"contains(lower(c), '{w}')" for w in words)

    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION comment_level(c STRING) RETURNS STRING "
        f"RETURN CASE WHEN {any_of(P1_WORDS)} THEN 'p1' "
        f"WHEN {any_of(P2_WORDS)} THEN 'p2' ELSE 'p3' END"
    )


def _accepted(text: Column) -> Column:
    # As the element of an array a pattern is matched once, though its number is compared twice.
    amount = F.array(F.regexp_replace(text, "[,， ]", "").try_cast("double"))
    return F.get(F.filter(amount, lambda a: a.between(*AMOUNT_RANGE)), F.lit(0))


def amount_in_text(comment: Column) -> Column:
    """Price mentioned in a comment.

    Each pattern offers its first match; the first one in range wins. After
    that any run of three or more digits in range counts, leftmost first.
    """
    offers = [
        _accepted(F.regexp_extract(comment, pattern, 1)) for pattern in AMOUNT_PATTERNS
    ]
    runs = F.filter(
        F.transform(
            F.regexp_extract_all(comment, F.lit(AMOUNT_RUNS), F.lit(1)),
            lambda r: r.try_cast("double"),
        ),
        lambda a: a.between(*AMOUNT_RANGE),
    )
    return F.coalesce(*offers, F.get(runs, F.lit(0)))


def amount(raw: Column, comment: Column) -> Column:
    """Order amount from its text form.

    Plain numbers are taken as they are, a four-character code sends us to
    the comment, everything else has no amount.
    """
    text = F.trim(raw)
    is_code = (F.char_length(text) == 4) & ~text.rlike(r"^\d+$") & (text != "null")
    return F.when(text.rlike(AMOUNT_NUMBER), text.try_cast("double")).when(
        is_code, amount_in_text(comment)
    )


def not_blank(comment: Column) -> Column:
    return comment.isNotNull() & comment.rlike(r"\S")


def ban_days(level: Column) -> Column:
    return lookup(level, BAN_DAYS, 0)


def action(level: Column) -> Column:
    return lookup(level, ACTIONS, "NONE")


def triggered_keyword(found: Column, level: Column) -> Column:
    """First P0 word, else first P1 word; absent for P2 and clean comments."""

    def first_of(wanted: str) -> Column:
        return F.get(F.filter(found, lambda w: w["level"] == wanted), F.lit(0))["word"]

    return F.when(level != "P2", F.coalesce(first_of("P0"), first_of("P1")))


def amount_text(value: Column) -> Column:
    """Whole amounts without a fraction, others with two digits, missing as 0."""
    whole = value.cast("bigint")
    return (
        F.when(value.isNull(), F.lit("0"))
        .when(value == whole, whole.cast("string"))
        .otherwise(F.format_string("%.2f", value))
    )


def result_json(origin: dict[str, str]) -> Column:
    """Moderation result as one JSON text; a null keyword leaves its field out.

    ``origin`` names the db, schema and table that the comments come from.
    """
    head = F.to_json(
        F.struct(
            F.coalesce("order_id", F.lit("")).alias("order_id"),
            F.coalesce("user_id", F.lit("")).alias("user_id"),
            F.coalesce("product_id", F.lit("")).alias("product_id"),
            F.coalesce("ds", F.lit("")).alias("ds"),
            F.col("ts").cast("string").alias("ts"),
            F.col("is_sensitive").alias("is_insulting"),
            F.col("comment").alias("user_comment"),
            *[F.lit(v).alias(k) for k, v in origin.items()],
            F.col("sensitive_level"),
            F.col("is_sensitive").alias("is_blocked"),
            ban_days(F.col("sensitive_level")).alias("blacklist_duration_days"),
            F.col("triggered_keyword"),
        )
    )
    # The amount is a bare number whose digits to_json would not choose.
    tail = F.concat(
        F.lit(',"total_amount":'),
        amount_text(F.col("amount")),
        F.lit(',"consumption_level":"'),
        F.coalesce("consumption_level", F.lit("LOW")),
        F.lit('"}'),
    )
    return F.concat(F.regexp_replace(head, r"\}$", ""), tail)
