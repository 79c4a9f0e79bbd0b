"""Streaming reports: the stored tables read as streams, run until drained.

Each must end with what its batch form gives, so they share its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as L, times
from ..streaming import jobs, profile, timers
from ..session import shared_dir
from ..sources.sinks import LineTable
from ..streaming.moderation import ModerationStream
from . import pairs as PR, remarks
from .common import logs_with
from .registry import REPORTS, report
from .tables import StreamTables, Tables


def _sql(name: str) -> str:
    return REPORTS[name].sql


@report("t1_t6_stream_daily_page_views", _sql("a1_daily_page_views"))
def t1(t: Tables):
    return jobs.run_to_end(
        jobs.daily_page_views(t.streaming("logs", files=3)), ["log_date", "log_type"]
    )


@report("t6_stream_page_views_10s", _sql("a2_page_views_10s"))
def t6(t):
    rows = jobs.run_to_end(
        jobs.windowed_page_views(t.streaming("logs", files=3)),
        ["window_start", "log_date", "log_type"],
    )
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    return rows.withColumns(shown)


@report(
    "t7_stream_arrival_windows",
    logs_with() + "SELECT log_type, count(*) AS pv FROM logs WHERE log_type IS NOT NULL GROUP BY log_type",
)
def t7(t):
    """Windows by processing time: when they lie is left to the clock, their sums are not."""
    rows = jobs.run_to_end(jobs.page_views_by_arrival(t.streaming("logs", files=3)), ["window_start", "log_type"])
    return rows.groupBy("log_type").agg(F.sum("pv").alias("pv"))


@report("t10_k4_stream_page_visits", _sql("a3_page_visit_totals"))
def t10(t):
    return jobs.run_to_end(jobs.running_page_visits(t.streaming("logs", files=3)), ["ds", "page_name"])


@report("t10_stream_search_words", _sql("a4_daily_search_words"))
def t10_words(t):
    return jobs.run_to_end(jobs.search_word_counts(t.streaming("logs", files=3)), ["log_date", "keyword"])


@report("t11_stream_words_after_quiet", _sql("w6_top_search_words"))
def t11(t):
    """Each date's first words, told once two seconds after its last search."""
    told = timers.live_table(
        timers.top_words_after_quiet(L.search_keywords(L.dated(t.streaming("logs")))), ["log_date", "share", "keyword"], timers.WAIT_MS
    )
    return timers.ranked_words(told)


@report("a10_stream_device_users", _sql("a10_device_users"))
def a10(t):
    return jobs.run_to_end(
        jobs.device_users(t.streaming("logs", files=3)), ["log_date", "plat", "brand", "platv"]
    )


@report("a13_stream_new_devices", _sql("a13_new_devices"))
def a13(t):
    return jobs.run_to_end(jobs.first_seen_devices(t.streaming("logs", files=3)), ["device_id"])


@report(
    "t8_stream_sessions",
    logs_with()
    + """, v AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS prev, log_id
      FROM d WHERE user_id IS NOT NULL AND user_id <> 'unknown'),
ss AS (SELECT *, max(CASE WHEN prev IS NULL OR ts - prev > 1800000 THEN ts END)
        OVER (PARTITION BY user_id ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS session_start FROM v)
SELECT user_id, session_start AS start_time, max(ts) AS end_time, count(*) AS total_events FROM ss
GROUP BY user_id, session_start""",
)
def t8(t):
    """All sessions: a log of nobody, a day behind the others, closes the open ones."""
    arriving = StreamTables(t.spark, t.sf_dir, 3)
    sessions = jobs.session_summaries(arriving.logs)
    return jobs.run_to_end(
        sessions, ["user_id", "start_time"], mode="append", closing=lambda: arriving.end(times.DAY_MS)
    )


@report("t9_stream_cumulative_gmv", _sql("q1_j1_gmv_topn"))
def t9(t):
    slices = jobs.run_to_end(
        jobs.sale_slices(t.streaming("sales", files=3)), ["step_end", "id", "product_id"]
    )
    shown = {
        c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        for c in ("window_start", "window_end")
    }
    return jobs.cumulative_gmv(slices).withColumns(
        {**shown, "gmv": F.col("gmv").cast("double")}
    )


def _inputs(t: Tables):
    comments = t.streaming("comments").select(
        F.col("doc_id").alias("comment_id"), "user_id", "ts", "order_id", "product_id", "ds"
    )
    logs = L.dated(t.streaming("logs")).select(*PR._LOG_COLUMNS)
    return comments, logs


@report("t5_j2_stream_interval_join", _sql("j2_interval_join"))
def t5(t):
    joined = jobs.interval_join(*_inputs(t)).select(
        "comment_id", "ts", "log_id", "log_ts", "ip"
    )
    return jobs.run_to_end(joined, ["comment_id", "log_id"], mode="append", count_state=False)


def _pairs(t: Tables, **options):
    """Comments, logs and user rows of all users, arriving over five triggers."""
    # Rows travel as JSON through the stream and its state, so they hold what the reports show.
    comments = PR.comments(t).select("user_id", "ts", "comment_id")
    logs = PR.logs(t).select("user_id", "ts", "log_id", "log_type", "brand", "plat")
    users = PR.users(t).select("user_id", "uname", F.coalesce("ts", F.lit(0)).alias("ts"))
    beside = ("ts", "log_type", "brand", "plat")  # they travel as columns
    rows = StreamTables(t.spark, t.sf_dir, 5).in_parts(profile.tagged(comments, logs, users, beside), F.col("at_ts"))
    arrived = profile.arrivals(rows, **options).select(
        "user_id",
        "at_ts",
        "at_tag",
        "at_id",
        "device_count",
        F.get_json_object("comment", "$.comment_id").cast("bigint").alias("comment_id"),
        "logs",
        F.get_json_object("user_info", "$.uname").alias("uname"),
    )
    stream = profile.listed_pairs(arrived).withColumn("log_id", F.get_json_object("log", "$.log_id"))
    columns = ["user_id", "at_ts", "at_tag", "at_id", "device_count", "comment_id", "log_id", "log_type", "uname", "log_no"]
    return jobs.run_to_end(stream.select(columns), columns[:4] + ["log_no"], mode="append", count_state=False)


@report("t13_stream_pairs_with_users", _sql("j6_pairs_with_users"))
def t13(t):
    return _pairs(t, suppress=False).select(
        "user_id", "at_id", "log_id", "log_type", "comment_id", "uname"
    )


@report(
    "t13_w12_stream_significant_pairs",
    PR.SIGNIFICANT_SQL
    + """SELECT user_id, at_ts, at_tag, at_id, device_count, comment_id, log_id, log_type, uname, log_no
FROM k JOIN walk USING (user_id, r) WHERE told""",
)
def t13_w12(t):
    return _pairs(t)


@report("k2_q5_stream_moderation", _sql("q5_p34_p36_moderation"))
def k2_q5(t):
    """Comments arriving over three triggers, their results written as lines to a sink and read back."""
    comments = StreamTables(t.spark, t.sf_dir, 3).arriving("comments").withColumnRenamed("doc_id", "comment_id")
    sink = LineTable(shared_dir(t.spark, "results"))
    stream = ModerationStream(t.spark, t.lexicon(), remarks._users(t), sink, shared_dir(t.spark, "moderation"))
    stream.start_on(comments, shared_dir(t.spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    columns = "is_sensitive boolean, masked_comment string, ban_days int, action string, sensitive_count bigint, user_name string, result string"
    return remarks.told(L.parse_json(sink.read(t.spark), columns))


_HOURS = """SELECT strftime(date_trunc('hour', make_timestamp({ms} * 1000)), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS records
FROM {rows} GROUP BY ALL"""


def _hours(rows, time):
    counts = jobs.run_to_end(jobs.counts_by_time(rows, time), ["window_start"])
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@report(
    "t2_stream_block_hours",
    logs_with() + _HOURS.format(ms="((ts // 1000 + CASE WHEN log_type = 'login' THEN 0 ELSE 3600 END) * 1000)", rows="d"),
)
def t2(t):
    """Hours of a block time in seconds; a login has none, so its own time counts."""
    own = F.floor(F.col("ts") / 1000)
    rows = L.dated(t.streaming("logs", files=3)).select(
        own.alias("timestamp"), F.when(F.col("log_type").eqNullSafe("login"), F.lit(None)).otherwise(own + 3600).alias("block_timestamp")
    )
    return _hours(rows, times.event_time_of_block("block_timestamp", "timestamp"))


@report("t3_stream_first_item_hours", logs_with() + _HOURS.format(ms="ts", rows="d"))
def t3(t):
    """Hours of the first item of each record's list."""
    item = lambda ms: F.struct(ms.alias("window_start_time"))
    rows = L.dated(t.streaming("logs", files=3)).select(F.array(item(F.col("ts")), item(F.col("ts") + times.DAY_MS)).alias("items"))
    return _hours(rows, times.event_time_of_first("items"))
