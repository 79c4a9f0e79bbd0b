"""Sources and sinks exercised end to end on files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import logs as L, profiles as P, users as U
from ..session import shared_dir
from ..sources import sinks, streams, tables as S
from ..streaming import jobs
from .clicks import _as_json
from .common import duck_with, logs_with
from .records import _USERS
from .registry import report
from .tables import Tables


def _topic_files(t: Tables) -> str:
    path = shared_dir(t.spark, "topic")
    _as_json(t).write.text(path)
    return path


_TYPES = duck_with("logs") + "SELECT log_type, count(*) AS events, count(ts) AS timed FROM logs GROUP BY log_type"


def _by_type(parsed):
    return parsed.groupBy("log_type").agg(F.count("*").alias("events"), F.count("ts").alias("timed"))


@report("s2_s3_text_topic", _TYPES)
def s3(t):
    """JSON lines written, read as text and parsed; malformed ones are ignored."""
    return _by_type(L.parse_logs(streams.file_lines(t.spark, _topic_files(t))))


@report("s1_stream_text_topic", _TYPES)
def s1(t):
    lines = streams.file_lines(t.spark, _topic_files(t), streaming=True)
    return jobs.run_to_end(_by_type(L.parse_logs(lines)), ["log_type"])


@report(
    "s7_lower_camel_rows",
    'SELECT o_orderkey AS "oOrderkey", o_custkey AS "oCustkey", o_orderstatus AS "oOrderstatus" FROM orders',
)
def s7(t):
    return S.renamed_lower_camel(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"))


@report(
    "s4_s5_snapshot_feed",
    "SELECT 'shop.dbo.customer' AS table_name, 'r' AS op, c_custkey, c_name FROM customer",
)
def s4(t):
    """Table rows as opening events, through JSON and back to rows."""
    from ..operators import changes as C

    source = {"db": "shop", "schema": "dbo", "table": "customer"}
    rows = t.customer.select("c_custkey", "c_name")
    lines = sinks.to_lines(S.snapshot(rows, source))
    return C.flatten(L.parse_json(lines, schemas.change_envelope(rows.schema)))


@report("s11_user_csv", duck_with("users") + "SELECT id, user_id, uname, birthday, gender, address, ts FROM users")
def s11(t):
    path = shared_dir(t.spark, "csv")
    columns = schemas.USER_INFO_BASE.fieldNames()
    t.users.select(*columns).write.csv(path, header=True, quote='"', escape='"')
    return S.user_csv(t.spark, path).drop("phone_num")


@report("k1_k3_topic_lines", _USERS + "SELECT user_id, age_group, constellation, birthday FROM en")
def k1(t):
    """Rows as keyed JSON records and back, dates as text."""
    lines = sinks.to_lines(U.enrich(t.users), key="user_id")
    parsed = L.parse_json(lines.drop("key"), schemas.USER_INFO_ENHANCED)
    return parsed.select(
        "user_id", "age_group", "constellation", F.col("birthday").cast("string").alias("birthday")
    )


@report(
    "k5_keyed_user_table",
    _USERS + "SELECT id, user_id, CASE WHEN id % 2 = 0 THEN 'new' ELSE age_group END AS age_group FROM en",
)
def k5(t):
    """A later batch replaces the rows with its keys."""
    rows = U.enrich(t.users).select("id", "user_id", "age_group")
    table = sinks.KeyedTable(shared_dir(t.spark, "keyed"), ["id"])
    table.upsert(rows, 0)
    table.upsert(rows.filter("id % 2 = 0").withColumn("age_group", F.lit("new")), 1)
    return table.read(t.spark)


@report("k10_copied_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def k10(t):
    rows = t.nation
    return L.parse_json(sinks.to_lines(rows), rows.schema)


@report(
    "p50_profile_metadata",
    logs_with()
    + """, h AS (SELECT user_id, bool_or(log_type IN ('login', 'search')) AS hist, max(ts) AS last_ts FROM d WHERE user_id IS NOT NULL GROUP BY user_id),
j AS (SELECT c_custkey, hist, last_ts FROM customer LEFT JOIN h ON h.user_id = CAST(c_custkey AS STRING))
SELECT c_custkey, CASE WHEN last_ts IS NULL THEN 'user_info' WHEN hist THEN 'log,user_info,behavior_history' ELSE 'log,user_info' END AS data_sources,
  CASE WHEN hist THEN 'batch_daily' ELSE 'realtime' END AS update_type, CAST(coalesce(last_ts, 0) AS STRING) AS ts FROM j""",
)
def p50(t):
    past = (
        L.dated(t.logs)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.max(F.col("log_type").isin("login", "search")).alias("hist"), F.max("ts").alias("last_ts"))
    )
    joined = t.customer.join(past, F.col("user_id") == F.col("c_custkey").cast("string"), "left")
    has = F.coalesce("hist", F.lit(False))
    sources = P.data_sources(
        log=F.col("last_ts").isNotNull(), user_info=F.lit(True), behavior_history=has
    )
    return joined.select(
        "c_custkey",
        F.array_join(sources, ",").alias("data_sources"),
        P.update_type(has).alias("update_type"),
        F.coalesce("last_ts", F.lit(0)).cast("string").alias("ts"),
    )


@report(
    "k4_keyed_table_batches",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS rn
FROM events) WHERE rn = 1 AND event_type <> 'signup'""",
)
def k4_batches(t):
    """Equal keys inside a batch, a repeated batch, and keys that a later row removes."""
    table = sinks.KeyedTable(shared_dir(t.spark, "keyed"), ["user_id"], order=["event_id"], deleted="gone")
    rows = t.events.select("user_id", "event_id", "event_type", (F.col("event_type") == "signup").alias("gone"))
    for batch in (0, 1, 1, 2):
        table.upsert(rows.filter(F.col("event_id") % 3 == batch), batch)
    return table.read(t.spark).select("user_id", "event_id", "event_type")
