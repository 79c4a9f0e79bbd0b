"""Comment and log joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as L
from ..operators import joins as J
from ..sources.staging import staged
from .common import logs_with
from .registry import report
from .tables import Tables

_LOG_COLUMNS = [
    "user_id", "ts", "log_id", "log_type", "order_id", "product_id", "ip", "keywords",
    "brand", "plat", "platv", "softv", "device", "userkey",
]


def comments(t: Tables):
    return t.comments.select(
        F.col("doc_id").alias("comment_id"), "user_id", "ts", "order_id", "product_id", "ds"
    )


def logs(t: Tables):
    return L.dated(t.logs).select(*_LOG_COLUMNS)


def narrow_line(t: Tables):
    """The timeline with the columns that reports of pairs show."""
    return J.timeline(comments(t).select("comment_id", "user_id", "ts"), logs(t), carried=["log_id", "log_type"])


def line(t: Tables):
    return staged(narrow_line(t), "timeline")


@report(
    "j2_interval_join",
    logs_with("comments")
    + """SELECT doc_id AS comment_id, c.ts, log_id, d.ts AS log_ts, ip FROM comments c JOIN d
ON c.order_id = d.order_id AND d.ts BETWEEN c.ts - 600000 AND c.ts + 300000""",
)
def j2(t):
    near = J.interval_join(comments(t), logs(t))
    return near.select("comment_id", "ts", "log_id", "log_ts", "ip")


_LINE = (
    logs_with("comments")
    + """, nd AS (SELECT log_id FROM (SELECT log_id, row_number() OVER (PARTITION BY user_id, lower(brand), lower(plat) ORDER BY ts, log_id)
        AS rn FROM d WHERE user_id IS NOT NULL AND brand IS NOT NULL AND plat IS NOT NULL) WHERE rn = 1),
u AS (SELECT user_id, ts AS at_ts, 0 AS at_tag, CAST(doc_id AS STRING) AS at_id, doc_id, CAST(NULL AS STRING) AS log_id, CAST(NULL AS STRING) AS log_type, 0 AS fresh FROM comments
  UNION ALL SELECT user_id, ts, 1, log_id, NULL, log_id, log_type, CASE WHEN log_id IN (SELECT log_id FROM nd) THEN 1 ELSE 0 END
  FROM d WHERE user_id IS NOT NULL),
tl AS (SELECT *, last_value(doc_id IGNORE NULLS) OVER w AS cur, CAST(sum(at_tag) OVER w AS BIGINT) AS n,
  CAST(sum(fresh) OVER w AS BIGINT) AS device_count FROM u
  WINDOW w AS (PARTITION BY user_id ORDER BY at_ts, at_tag, at_id ROWS UNBOUNDED PRECEDING))
"""
)


@report(
    "j3_comment_log_coverage",
    _LINE
    + """SELECT user_id, at_ts, at_tag, at_id, CASE WHEN at_tag = 1 THEN n END AS log_no,
  CASE WHEN at_tag = 1 THEN cur END AS current_comment, CASE WHEN at_tag = 0 THEN n END AS earlier_logs FROM tl""",
)
def j3(t):
    return J.coverage(narrow_line(t))


def _pairs_sql(buffer: int) -> str:
    return (
        _LINE
        + f""", pr AS (SELECT user_id, at_ts, at_tag, at_id, device_count, cur AS comment_id, log_id, log_type, n AS log_no FROM tl
   WHERE at_tag = 1 AND cur IS NOT NULL
 UNION ALL SELECT c.user_id, c.at_ts, c.at_tag, c.at_id, c.device_count, c.doc_id, l.log_id, l.log_type, l.n FROM tl c JOIN tl l
   ON c.user_id = l.user_id AND c.at_tag = 0 AND l.at_tag = 1 AND l.n BETWEEN c.n - {buffer - 1} AND c.n)
"""
    )


def _shown(pairs):
    return pairs.select(
        "user_id", "at_ts", "at_tag", "at_id", "device_count", "comment.comment_id",
        "log.log_id", "log.log_type", "log_no",
    )


@report("j4_newest_log_pairs", _pairs_sql(1) + "SELECT * FROM pr")
def j4(t):
    return _shown(J.comment_log_pairs(line(t), buffer=1))


@report("j5_buffered_pairs", _pairs_sql(50) + "SELECT * FROM pr")
def j5(t):
    return _shown(J.comment_log_pairs(line(t)))


@report(
    "j5_pair_devices",
    _pairs_sql(1)
    + """, ud AS (SELECT user_id, brand, plat, row_number() OVER (PARTITION BY user_id ORDER BY ts, log_id) AS pos
   FROM d WHERE log_id IN (SELECT log_id FROM nd))
SELECT pr.user_id, at_id, pr.log_id, coalesce(string_agg(brand || '/' || plat, ',' ORDER BY pos), '') AS devices
FROM pr LEFT JOIN ud ON ud.user_id = pr.user_id AND pos <= device_count GROUP BY ALL""",
)
def j5_devices(t):
    pairs = J.with_device_list(J.comment_log_pairs(line(t), buffer=1), logs(t))
    names = F.transform("devices", lambda x: F.concat_ws("/", x["brand"], x["plat"]))
    return pairs.select(
        "user_id", "at_id", "log.log_id", F.coalesce(F.array_join(names, ","), F.lit("")).alias("devices")
    )


def users(t: Tables):
    from ..functions import users as U

    return U.enrich(t.users).withColumn("birthday", F.col("birthday").cast("string"))


@report(
    "j6_pairs_with_users",
    _pairs_sql(50)
    + """SELECT pr.user_id, at_id, log_id, log_type, comment_id, c_name AS uname FROM pr
JOIN customer ON CAST(c_custkey AS STRING) = pr.user_id
WHERE c_custkey % 53 = 0 OR (c_custkey % 59 <> 0 AND c_custkey % 61 <> 0)""",
)
def j6(t):
    joined = J.with_user_info(J.comment_log_pairs(line(t)), users(t).select("user_id", "uname"))
    return joined.select(
        "user_id", "at_id", "log.log_id", "log.log_type", "comment.comment_id", "user_info.uname"
    )


_HAS_PROFILE = """JOIN customer ON CAST(c_custkey AS STRING) = pr.user_id
WHERE c_custkey % 53 = 0 OR (c_custkey % 59 <> 0 AND c_custkey % 61 <> 0)"""

# The rule is walked pair by pair: what was reported last goes from row to row.
SIGNIFICANT_SQL = (
    _pairs_sql(50).replace("WITH", "WITH RECURSIVE", 1)
    + f""", k AS (SELECT pr.*, c_name AS uname, lower(log_type) AS ty,
  row_number() OVER (PARTITION BY user_id ORDER BY at_ts, at_tag, at_id, log_no) AS r FROM pr {_HAS_PROFILE}),
walk AS (
  SELECT user_id, r, true AS told, at_ts AS told_ts, ty AS told_ty, device_count AS told_n FROM k WHERE r = 1
  UNION ALL
  SELECT user_id, r, told, CASE WHEN told THEN at_ts ELSE told_ts END, CASE WHEN told THEN ty ELSE told_ty END,
    CASE WHEN told THEN device_count ELSE told_n END
  FROM (SELECT k.user_id, k.r, k.at_ts, k.ty, k.device_count, w.told_ts, w.told_ty, w.told_n,
      coalesce(k.ty IN ('payment', 'login', 'purchase', 'checkout', 'order', 'search'), false)
        OR k.ty IS DISTINCT FROM w.told_ty OR k.device_count <> w.told_n OR k.at_ts - w.told_ts > 60000 AS told
    FROM walk w JOIN k ON k.user_id = w.user_id AND k.r = w.r + 1))
"""
)


@report(
    "w12_significant_pairs",
    SIGNIFICANT_SQL
    + """SELECT user_id, at_ts, at_tag, at_id, device_count, comment_id, log_id, log_type, log_no
FROM k JOIN walk USING (user_id, r) WHERE told""",
)
def w12(t):
    """Pairs of users with a profile that say something new: users first, as in the job."""
    remarks, known = J.of_commenters(comments(t).select("comment_id", "user_id", "ts"), logs(t), users(t))
    drawn = staged(J.timeline(remarks, known, carried=["log_id", "log_type"]), "timeline")
    arrivals, with_pairs = J.reports(drawn, J.LOG_BUFFER, "log_id", "log_type")
    return J.pair_rows(with_pairs(arrivals)).select(
        "user_id", *J.AT, "device_count", "comment_id", "log.log_id", "log.log_type", "log_no"
    )


@report(
    "w10_recent_logs",
    logs_with()
    + """SELECT user_id, log_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, log_id DESC) AS rn
FROM d WHERE user_id IS NOT NULL) WHERE rn <= 20""",
)
def w10(t):
    rows = logs(t).filter(F.col("user_id").isNotNull())
    return J.recent(rows, "user_id", ["ts", "log_id"], 20).select("user_id", "log_id", "ts")


@report(
    "w11_latest_log",
    logs_with()
    + """SELECT user_id, log_id, ts, log_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, log_id DESC) AS rn
FROM d WHERE user_id IS NOT NULL) WHERE rn = 1""",
)
def w11(t):
    rows = logs(t).filter(F.col("user_id").isNotNull()).select("user_id", "log_id", "ts", "log_type")
    return J.latest(rows, "user_id", ["ts", "log_id"])
