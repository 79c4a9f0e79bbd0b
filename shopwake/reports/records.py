"""User enrichment, change-feed and wide-column reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import logs as L, users as U
from ..operators import changes as C, wide
from .common import duck_with
from .registry import report
from .tables import Tables

_PARTS = """, b AS (SELECT *, TRY_CAST(substr(birthday, 1, 4) AS INTEGER) AS y, TRY_CAST(substr(birthday, 6, 2) AS INTEGER) AS m,
      TRY_CAST(substr(birthday, 9, 2) AS INTEGER) AS dd FROM users),
ok AS (SELECT * FROM b WHERE birthday LIKE '____-__-__' AND y BETWEEN 1900 AND 2025 AND m BETWEEN 1 AND 12
       AND dd BETWEEN 1 AND 31),
en AS (SELECT TRY_CAST(ts AS BIGINT) AS ts, CAST(id AS BIGINT) AS id, user_id, uname, phone_num,
  CAST(TRY_CAST(birthday AS DATE) AS STRING) AS birthday, gender, address,
  CASE WHEN y BETWEEN 1960 AND 2009 THEN lpad(CAST((y % 100) // 10 * 10 AS STRING), 2, '0') || '后' ELSE '其他' END AS age_group,
  CASE WHEN (m = 3 AND dd >= 21) OR (m = 4 AND dd <= 19) THEN '白羊'
       WHEN (m = 4) OR (m = 5 AND dd <= 20) THEN '金牛'
       WHEN (m = 5) OR (m = 6 AND dd <= 21) THEN '双子'
       WHEN (m = 6) OR (m = 7 AND dd <= 22) THEN '巨蟹'
       WHEN (m = 7) OR (m = 8 AND dd <= 22) THEN '狮子'
       WHEN (m = 8) OR (m = 9 AND dd <= 22) THEN '处女'
       WHEN (m = 9) OR (m = 10 AND dd <= 23) THEN '天秤'
       WHEN (m = 10) OR (m = 11 AND dd <= 22) THEN '天蝎'
       WHEN (m = 11) OR (m = 12 AND dd <= 21) THEN '射手'
       WHEN (m = 12) OR (m = 1 AND dd <= 19) THEN '摩羯'
       WHEN (m = 1) OR (m = 2 AND dd <= 18) THEN '水瓶'
       WHEN (m = 2) OR (m = 3) THEN '双鱼' ELSE '未知' END AS constellation
  FROM ok)
"""
_USERS = duck_with("users") + _PARTS


def _text_birthday(df):
    return df.withColumn("birthday", F.col("birthday").cast("string"))


@report("p17_valid_birthdays", _USERS + "SELECT user_id, birthday FROM ok")
def p17(t):
    return t.users.filter(U.valid_birthday(F.col("birthday"))).select("user_id", "birthday")


@report("p18_decades", _USERS + "SELECT age_group, count(*) AS users FROM en GROUP BY age_group")
def p18(t):
    return U.enrich(t.users).groupBy("age_group").agg(F.count("*").alias("users"))


@report(
    "p19_zodiac_signs",
    _USERS + "SELECT constellation, count(*) AS users FROM en GROUP BY constellation",
)
def p19(t):
    return U.enrich(t.users).groupBy("constellation").agg(F.count("*").alias("users"))


@report("q6_p20_enriched_users", _USERS + "SELECT * FROM en")
def q6(t):
    return _text_birthday(U.enrich(t.users))


_AS_OF = "2025-10-23"


@report(
    "p37_p38_user_labels",
    _USERS
    + f"""SELECT user_id,
  coalesce(CAST(2025 - year(CAST(birthday AS DATE)) - CASE WHEN month(CAST(birthday AS DATE)) * 100 + day(CAST(birthday AS DATE)) > 1023
       THEN 1 ELSE 0 END AS INTEGER), 0) AS age,
  CASE gender WHEN 1 THEN '男' WHEN 0 THEN '女' ELSE '未知' END AS gender, constellation || '座' AS zodiac_sign FROM en""",
)
def p37(t):
    return U.enrich(t.users).select(
        "user_id",
        U.age_on(F.col("birthday"), F.lit(_AS_OF).cast("date")).alias("age"),
        U.gender_label(F.col("gender")).alias("gender"),
        U.sign_label(F.col("constellation")).alias("zodiac_sign"),
    )


@report(
    "p33_k6_change_records",
    _USERS
    + "SELECT user_id, uname, gender, age_group, constellation, birthday, ts FROM en",
)
def p33(t):
    """Enriched users written as change records and read back."""
    records = C.change_records(_text_birthday(U.enrich(t.users)), "ts")
    rows = L.parse_json(records, schemas.USER_INFO_ENVELOPE)
    first = F.get("data", F.lit(0))
    return rows.select(
        *[first[c].alias(c) for c in ("user_id", "uname", "gender", "age_group", "constellation", "birthday")],
        "ts",
    )


def _feed(t: Tables):
    """Order changes as envelopes: snapshot, updates and deletes."""
    row = F.struct(
        "o_orderkey",
        "o_custkey",
        F.col("price").cast("decimal(18,2)").alias("price"),
        "status",
    )
    return t.changes.select(
        F.when(F.col("op") != "d", row).alias("after"),
        F.when(F.col("op") == "d", row).alias("before"),
        "op",
        F.struct(
            F.lit("shop").alias("db"), F.lit("dbo").alias("schema"), F.lit("orders").alias("table")
        ).alias("source"),
        "ts_ms",
    )


@report(
    "p12_change_rows",
    duck_with("changes")
    + """SELECT o_orderkey, o_custkey, CAST(price AS DOUBLE) AS price, status, 'shop.dbo.orders' AS table_name, op
FROM changes WHERE op <> 'd'""",
)
def p12(t):
    return C.flatten(_feed(t)).withColumn("price", F.col("price").cast("double"))


@report(
    "p13_content_changes",
    duck_with("changes") + "SELECT op, count(*) AS changes FROM changes WHERE op IN ('c', 'u', 'r') GROUP BY op",
)
def p13(t):
    return C.content_changes(_feed(t)).groupBy("op").agg(F.count("*").alias("changes"))


_LATEST = """, n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts_ms DESC) AS rn FROM changes),
cur AS (SELECT o_orderkey, o_custkey, CAST(price AS DOUBLE) AS price, status FROM n WHERE rn = 1 AND op <> 'd')
"""


@report("j9_latest_state", duck_with("changes") + _LATEST + "SELECT * FROM cur")
def j9(t):
    current = C.latest_state(t.changes, ["o_orderkey"], ["ts_ms"])
    return current.select(
        "o_orderkey", "o_custkey", F.col("price").cast("double").alias("price"), "status"
    )


@report("s6_merged_state", duck_with("changes") + _LATEST + "SELECT * FROM cur")
def s6(t):
    """Snapshot first, later changes merged into it."""
    rows = t.changes.withColumn("price", F.col("price").cast("decimal(18,2)"))
    snapshot = rows.filter("op = 'r'").drop("op")
    merged = C.merge_state(snapshot, rows.filter("op <> 'r'"), ["o_orderkey"], ["ts_ms"])
    return merged.select(
        "o_orderkey", "o_custkey", F.col("price").cast("double").alias("price"), "status"
    )


@report(
    "q10_change_feed_to_records",
    duck_with("changes")
    + """SELECT o_orderkey, CAST(price AS DOUBLE) AS price, 'shop.dbo.orders' AS table_name, op FROM changes WHERE op <> 'd'""",
)
def q10(t):
    from ..plans import jobs

    lines = jobs.change_feed_lines(_feed(t))
    parsed = L.parse_json(
        lines, "o_orderkey BIGINT, price DOUBLE, table_name STRING, op STRING"
    )
    return parsed


_CELLS = """, cells AS (
 SELECT CAST(c_custkey AS STRING) AS row_key, 'info' AS family, 'c_name' AS qualifier, c_name AS value FROM customer
 UNION ALL SELECT CAST(c_custkey AS STRING), 'info', 'c_nationkey', CAST(c_nationkey AS STRING) FROM customer
 UNION ALL SELECT CAST(c_custkey AS STRING), 'info', 'c_mktsegment', c_mktsegment FROM customer)
"""


def _cells(t: Tables):
    return wide.to_cells(
        t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey"
    )


@report("k7_wide_cells", duck_with("users") + _CELLS + "SELECT * FROM cells")
def k7(t):
    return _cells(t)


@report(
    "s8_wide_scan",
    duck_with("users")
    + _CELLS
    + "SELECT row_key, string_agg(qualifier || '=' || value, ',' ORDER BY qualifier) AS cells FROM cells GROUP BY row_key",
)
def s8(t):
    return _as_text(wide.scan(_cells(t)))


@report(
    "s8_wide_scan_limited",
    duck_with("users")
    + _CELLS
    + """SELECT row_key, string_agg(qualifier || '=' || value, ',' ORDER BY qualifier) AS cells FROM cells
WHERE row_key IN (SELECT DISTINCT row_key FROM cells ORDER BY row_key LIMIT 25) GROUP BY row_key""",
)
def s8_limited(t):
    """A scan that stops after its limit of row keys."""
    return _as_text(wide.scan(_cells(t), limit=25))


def _as_text(scanned):
    entries = F.map_entries("cells")
    return scanned.select(
        "row_key",
        F.array_join(
            F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ","
        ).alias("cells"),
    )


@report(
    "s9_wide_row_count",
    duck_with("users") + _CELLS + "SELECT count(DISTINCT row_key) AS row_count FROM cells",
)
def s9(t):
    return wide.row_count(_cells(t))


@report(
    "s10_wide_lookup",
    duck_with("users") + _CELLS + "SELECT row_key, qualifier, value FROM cells WHERE row_key = '7'",
)
def s10(t):
    return wide.lookup(_cells(t), "7")


@report(
    "k8_delete_by_keys",
    duck_with("users")
    + _CELLS
    + """SELECT row_key, qualifier, value FROM cells
WHERE row_key NOT IN (SELECT CAST(o_custkey AS STRING) FROM orders WHERE o_orderstatus = 'F')""",
)
def k8(t):
    doomed = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("string").alias("row_key")
    )
    return C.without_keys(_cells(t), doomed, "row_key").select("row_key", "qualifier", "value")
