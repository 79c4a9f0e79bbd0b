"""User enrichment: birthday checks, decade, zodiac sign, age, gender."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decade labels by first year.
DECADES = {
    1960: "60后",
    1970: "70后",
    1980: "80后",
    1990: "90后",
    2000: "00后",
}
OTHER_DECADE = "其他"
# Sign -> first (month, day); each lasts until the next begins.
ZODIAC_STARTS = {
    "水瓶": (1, 20),
    "双鱼": (2, 19),
    "白羊": (3, 21),
    "金牛": (4, 20),
    "双子": (5, 21),
    "巨蟹": (6, 22),
    "狮子": (7, 23),
    "处女": (8, 23),
    "天秤": (9, 23),
    "天蝎": (10, 24),
    "射手": (11, 23),
    "摩羯": (12, 22),
}
UNKNOWN_SIGN = "未知"
# Gender codes.
GENDERS = {1: "男", 0: "女"}
UNKNOWN_GENDER = "未知"


def birthday_parts(birthday: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) as integers, null where the text has none."""
    return tuple(
        F.substring(birthday, start, length).try_cast("int")
        for start, length in ((1, 4), (6, 2), (9, 2))
    )


def valid_birthday(birthday: Column) -> Column:
    """Shape ``____-__-__`` with a plausible year, month and day."""
    year, month, day = birthday_parts(birthday)
    return F.coalesce(
        birthday.like("____-__-__")
        & year.between(1900, 2025)
        & month.between(1, 12)
        & day.between(1, 31),
        F.lit(False),
    )


def decade(year: Column) -> Column:
    label = F
    for first, name in DECADES.items():
        label = label.when(year.between(first, first + 9), name)
    return label.otherwise(OTHER_DECADE)


def zodiac(month: Column, day: Column) -> Column:
    """Sign of a month and day; the year starts in the last sign."""
    mmdd = month * 100 + day
    sign = F.when(
        ~F.coalesce(month.between(1, 12) & day.between(1, 31), F.lit(False)), UNKNOWN_SIGN
    )
    for name, (m, d) in reversed(ZODIAC_STARTS.items()):
        sign = sign.when(mmdd >= m * 100 + d, name)
    return sign.otherwise(next(reversed(ZODIAC_STARTS)))


def sign_label(sign: Column) -> Column:
    """Sign with the 座 suffix exactly once; blank stays blank."""
    s = F.coalesce(sign, F.lit(""))
    return F.when((s != "") & ~s.endswith("座"), F.concat(s, F.lit("座"))).otherwise(s)


def gender_label(code: Column) -> Column:
    label = F
    for value, name in GENDERS.items():
        label = label.when(code == value, name)
    return label.otherwise(UNKNOWN_GENDER)


def age_on(birthday: Column, as_of: Column) -> Column:
    """Whole years lived on ``as_of``; 0 where the birthday is unusable."""
    born = birthday.try_cast("date")
    years = F.year(as_of) - F.year(born)
    before = (F.month(as_of) * 100 + F.day(as_of)) < (F.month(born) * 100 + F.day(born))
    return F.coalesce(years - before.cast("int"), F.lit(0))


def enrich(df, shape_only_rows: bool = True):
    """User table with birthday as a date, decade and sign.

    Rows whose birthday has the wrong shape are dropped; a well-shaped date
    that does not exist keeps its row with a null birthday.
    """
    year, month, day = birthday_parts(F.col("birthday"))
    rows = df.filter(valid_birthday(F.col("birthday"))) if shape_only_rows else df
    return rows.select(
        F.col("ts").try_cast("bigint").alias("ts"),
        F.col("id").try_cast("bigint").alias("id"),
        "user_id",
        "uname",
        "phone_num",
        F.col("birthday").try_cast("date").alias("birthday"),
        "gender",
        "address",
        decade(year).alias("age_group"),
        zodiac(month, day).alias("constellation"),
    )
