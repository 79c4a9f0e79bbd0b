"""The logical tables, derived from the stored ones.

Each table is one SELECT that both engines accept after filling in a few
placeholders, so a query and its SQL check start from identical rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import is_folder, shared_dir
from ..sources.streams import stored_table

STORED = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The generator makes ms and k columns of their own, computed once per row.
SPARK = {
    "parsed_events": (
        "events LATERAL VIEW inline(array(named_struct("
        "'ms', unix_millis(CAST(ts AS TIMESTAMP)), "
        "'k', CAST(get_json_object(props, '$.k') AS BIGINT)))) p AS ms, k"
    ),
    "div": "div",
    "list": "array",
    "day": "CAST(date_add(DATE '1955-01-01', CAST({n} AS INT)) AS STRING)",
    "date_of": "CAST(CAST(timestamp_millis({n}) AS DATE) AS STRING)",
}
DUCK = {
    "parsed_events": (
        "(SELECT *, epoch_us(ts) // 1000 AS ms, "
        "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) p"
    ),
    "div": "//",
    "list": "list_value",
    "day": "CAST(CAST(DATE '1955-01-01' + CAST({n} AS INTEGER) AS DATE) AS STRING)",
    "date_of": "CAST(CAST(make_timestamp({n} * 1000) AS DATE) AS STRING)",
}


def _pick(index: str, *values: str | None) -> str:
    """CASE text choosing the i-th value."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'")
        for i, v in enumerate(values)
    )
    return f"CASE ({index}) % {len(values)} {arms} END"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


WORDS = (
    "瑜伽裤", "running shoe", "yoga mat", "上衣", "训练 shirt", "pants",
    "跑步鞋", "socks", "training top", "水杯", "tank top", "run cap",
    "legging", "null", "外套",
)

_IP = "(10 + (user_id * 7 + k) % 27) * 16777216 + (user_id * 65537 + k * 257) % 16777216"

LOGS = f"""
SELECT event_id,
       'log' || {_text('event_id')} AS log_id,
       CASE WHEN event_id % 227 = 0 THEN NULL WHEN event_id % 229 = 0 THEN 'heartbeat' ELSE
         CASE event_type WHEN 'signup' THEN 'login' WHEN 'view' THEN 'page_view'
            WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'payment'
            ELSE 'product_list' END END AS log_type,
       CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 223 = 0 THEN 'unknown'
            ELSE {_text('user_id')} END AS user_id,
       'o' || {_text('user_id % 20')} || '-' || {_text('ms %(div)s 86400000')} AS order_id,
       {_pick('k', 'AIM', 'Align', 'Fast')} || '-' || {_text('k')} AS product_id,
       {_pick('k', 'pageinfo', 'payment', 'collect', 'add', None, 'share')} AS opa,
       CASE WHEN event_id % 199 = 0 THEN NULL
            WHEN event_id % 2 = 0 THEN ms %(div)s 1000 ELSE ms END AS ts,
       %(list)s({_pick('k', *WORDS)}, '  ' || {_pick('k * 7 + user_id', *WORDS)}, ' ',
                {_pick('k + user_id * 3', *WORDS)}) AS keywords,
       {_pick('k', 'Mozilla Android 12', 'Mozilla iPad', 'Windows NT 10', 'Mac OS X', None)} AS user_agent,
       CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN ''
            WHEN event_id % 103 = 0 THEN '300.1.1.1' WHEN event_id % 107 = 0 THEN '1.-2.3.4'
            ELSE {_text('(ipn %(div)s 16777216)')} || '.' || {_text('(ipn %(div)s 65536) % 256')}
              || '.' || {_text('(ipn %(div)s 256) % 256')} || '.' || {_text('ipn % 256')} END AS ip,
       CASE WHEN k % 19 = 0 THEN ' ' ELSE 'prov' || {_text('k % 6')} END AS province,
       CASE WHEN k % 23 = 0 THEN NULL ELSE 'city' || {_text('k % 11')} END AS city,
       {_pick('user_id + k % 4', 'HUAWEI', 'honor x', 'Xiaomi', 'MI 10', 'OPPO', 'vivo', 'Samsung',
              'Apple iPhone', 'OnePlus', 'acme', '', None)} AS brand,
       {_pick('user_id + k % 3', 'Android', 'ios', 'iPhone OS', 'Windows NT', 'macOS', 'linux',
              'other')} AS plat,
       'v' || {_text('k % 3')} AS platv,
       's' || {_text('k % 5')} AS softv,
       CASE WHEN k % 37 = 0 THEN ' ' ELSE ' model' || {_text('(user_id + k) % 13')} END AS device,
       CASE WHEN k % 41 = 0 THEN NULL
            ELSE 'dev' || {_text('user_id * 4 + k % 4')} END AS userkey
FROM (SELECT *, {_IP} AS ipn
      FROM (SELECT event_id, event_type, user_id, ms, k FROM %(parsed_events)s) e) e
"""

SALES = f"""
SELECT {_text('user_id')} AS id,
       'o' || {_text('event_id')} AS order_id,
       {_text('user_id')} AS user_id,
       'name' || {_text('user_id')} AS user_name,
       'p' || {_text('k')} AS product_id,
       CAST(value AS DECIMAL(10, 2)) AS total_amount,
       CASE event_id % 3 WHEN 0 THEN {_text('ms %(div)s 1000')} || '.5'
            WHEN 1 THEN {_text('ms')} ELSE '' END AS ts,
       ms AS insert_time,
       {_pick('event_id', 'r', '+I', '+U', 'r', '-D')} AS op
FROM (SELECT event_id, user_id, value, ms, k
      FROM %(parsed_events)s WHERE event_type = 'purchase') e
"""

USERS = f"""
SELECT CAST(c_custkey AS INT) AS id,
       {_text('c_custkey')} AS user_id,
       c_name AS uname,
       '1' || {_text('3000000000 + c_custkey')} AS phone_num,
       CASE WHEN c_custkey % 53 = 0 THEN '1993-02-30'
            WHEN c_custkey % 59 = 0 THEN '992-08-24'
            WHEN c_custkey % 61 = 0 THEN NULL
            ELSE %(birthday)s END AS birthday,
       CAST(c_custkey % 3 AS INT) AS gender,
       c_mktsegment || ', ' || {_text('c_nationkey')} AS address,
       CASE WHEN c_custkey % 2 = 0 THEN {_text('1704067200000 + c_custkey')}
            ELSE '2024-01-01 08:28:52' END AS ts
FROM customer
"""

_TAIL = (
    f"' ' || {_pick('doc_id', '女款', '男士', '一般', '', '垃圾', '毒品', '不错', 'SB')}"
)
_TS = "(1704067200000 + ((doc_id * 7919) % 43200) * 60000)"

COMMENTS = f"""
SELECT doc_id,
       'o' || {_text('(doc_id % 150) % 20')} || '-' || {_text(_TS + ' %(div)s 86400000')} AS order_id,
       CASE WHEN doc_id % 67 = 0 THEN 'guest' ELSE {_text('doc_id % 150')} END AS user_id,
       'p' || {_text('doc_id % 97')} AS product_id,
       CASE doc_id % 5 WHEN 0 THEN {_text('n_chars * 3')} WHEN 1 THEN ' '
            WHEN 2 THEN 'null' WHEN 3 THEN 'AlmQ' ELSE {_text('n_chars')} || '.50' END AS total_amount,
       %(comment_day)s AS ds,
       {_TS} AS ts,
       CASE WHEN doc_id % 101 = 0 THEN ' ' ELSE text || {_TAIL}
            || CASE doc_id % 3 WHEN 0 THEN ' 花了' || {_text('n_chars')}
                    WHEN 1 THEN ' ' || {_text('n_chars * 7')} || '元' ELSE '' END END AS comment
FROM documents
"""


def _ip_half(h: int) -> str:
    region = (
        "CASE n_nationkey % 5 "
        f"WHEN 0 THEN '中国|' || n_name || '省' || r_name || '{h}市|ISP' "
        f"WHEN 1 THEN '中国|' || n_name || '自治区' || r_name || '{h}|0' "
        f"WHEN 2 THEN '中国|0|' || n_name || '市|' || r_name "
        f"WHEN 3 THEN '中国|' || n_name || '省|0' "
        "ELSE '0|0|lan' END"
    )
    return (
        f"SELECT (10 + n_nationkey) * CAST(16777216 AS BIGINT) + {h * 8388608} AS start_ip, "
        f"(10 + n_nationkey) * CAST(16777216 AS BIGINT) + {h * 8388608 + 8388607} AS end_ip, "
        f"{region} AS region "
        "FROM nation JOIN region ON n_regionkey = r_regionkey"
    )


IP_RANGES = _ip_half(0) + " UNION ALL " + _ip_half(1)

CITIES = """
SELECT n_name AS city, r_name || '省' AS province
FROM nation JOIN region ON n_regionkey = r_regionkey
"""

CHANGES = f"""
SELECT 'r' AS op, o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS price,
       o_orderstatus AS status, CAST(1 AS BIGINT) AS ts_ms FROM orders
UNION ALL
SELECT 'u', o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18, 2)) + CAST(1.25 AS DECIMAL(18, 2)),
       'X', CAST(2 AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0
UNION ALL
SELECT 'd', o_orderkey, NULL, NULL, NULL, CAST(3 AS BIGINT) FROM orders WHERE o_orderkey % 10 = 0
"""

# Words of the three levels that occur in the comments, overlapping on purpose.
LEXICON = {
    "thorea": "P0",
    "毒品": "P0",
    "thor": "P1",
    "license": "P1",
    "垃圾": "P1",
    "ción": "P2",
    "shst": "P2",
    "一般": "P2",
}

DERIVED = {
    "logs": LOGS,
    "sales": SALES,
    "users": USERS,
    "comments": COMMENTS,
    "ip_ranges": IP_RANGES,
    "cities": CITIES,
    "changes": CHANGES,
}


def _fill(text: str, engine: dict[str, str]) -> str:
    values = {
        **{k: v for k, v in engine.items() if k not in ("day", "date_of")},
        "birthday": engine["day"].format(n="(c_custkey * 97) % 22000"),
        "comment_day": engine["date_of"].format(n=_TS),
    }
    # '%' stays a plain operator, so placeholders are replaced by name only.
    for name, value in values.items():
        text = text.replace(f"%({name})s", value)
    return text


def duck_with(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the SQL checks."""
    parts = [f"{n} AS ({_fill(DERIVED[n], DUCK).strip()})" for n in names]
    return "WITH " + ",\n".join(parts)


FILE_ROWS = 100_000  # rows of an arriving file, on average


class Tables:
    """Reads stored tables of one folder and derives the logical ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED:
            return self.stored(name)
        if name in DERIVED:
            text = _fill(DERIVED[name], SPARK)
            sources = {s: self.stored(s) for s in STORED if f" {s}" in text}
            for source in sources:
                text = _reference(text, source)
            return self.spark.sql(text, **sources)
        raise AttributeError(name)

    def streaming(self, name: str, files: int = 1) -> DataFrame:
        """A derived table over streams of the stored ones. With several
        ``files``, events come in as many triggers, in time order."""
        return StreamTables(self.spark, self.sf_dir, files).__getattr__(name)

    def lexicon(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(LEXICON.items()), "word string, level string"
        )


class StreamTables(Tables):
    """The same tables, read as streams."""

    def __init__(self, spark: SparkSession, sf_dir: str, files: int = 1):
        super().__init__(spark, sf_dir)
        self.files, self.arrivals = files, None

    def stored(self, name: str) -> DataFrame:
        rows = super().stored(name)
        if name == "events" and self.files > 1:
            path, per_trigger = self._in_order(rows, F.unix_millis(F.col("ts").cast("timestamp")))
            return stored_table(self.spark, path, "*.parquet", rows.schema, per_trigger)
        path = f"{self.sf_dir}/{name}.parquet"
        if is_folder(self.spark, path):  # a large table: part files in a folder of its own
            return stored_table(self.spark, path, "*.parquet", rows.schema)
        return stored_table(self.spark, self.sf_dir, f"{name}.parquet", rows.schema)

    def arriving(self, name: str) -> DataFrame:
        """A derived table with ``ts`` in ms, its rows arriving in time order."""
        return self.in_parts(Tables(self.spark, self.sf_dir).__getattr__(name), F.col("ts"))

    def in_parts(self, rows: DataFrame, ms: Column) -> DataFrame:
        """Rows that arrive in the order of ``ms``."""
        path, per_trigger = self._in_order(rows, ms)
        return stored_table(self.spark, path, "*.parquet", rows.schema, per_trigger)

    def _in_order(self, rows: DataFrame, ms: Column) -> tuple[str, int]:
        """The rows cut by time into equal parts, written one after another, and the files of
        each. Rows without a time come with the first part; an empty table is one empty part."""
        self.arrivals = shared_dir(self.spark, "arrivals")
        shares = [i / self.files for i in range(1, self.files)]
        found = rows.agg(F.percentile_approx(ms, shares).alias("cuts"), F.count("*").alias("n")).first()
        cuts = sorted(set(found["cuts"] or []))
        per_trigger = max(1, math.ceil(found["n"] / self.files / FILE_ROWS))
        part = sum((F.when(ms > c, 1).otherwise(0) for c in cuts), F.lit(0))
        for i in range(len(cuts) + 1):
            rows.filter(part == i).repartition(per_trigger).write.mode("append").parquet(self.arrivals)
        return self.arrivals, per_trigger

    def end(self, after_ms: int) -> None:
        """One more arrival behind all others: an event of nobody, ``after_ms`` later."""
        rows = super().stored("events")
        last = rows.agg(F.max("ts").cast("timestamp")).first()[0]
        if last is not None:
            moment = F.timestamp_millis(F.unix_millis(F.max(F.col("ts").cast("timestamp"))) + after_ms)
            marker = rows.agg(moment.alias("ts"))
            values = [(F.col("ts") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
            marker.select(*values).write.mode("append").parquet(self.arrivals)


def _reference(text: str, source: str) -> str:
    for keyword in ("FROM", "JOIN"):
        text = text.replace(f"{keyword} {source}", f"{keyword} {{{source}}}")
    return text
