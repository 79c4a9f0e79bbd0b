"""Sales reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import gmv
from .common import utc_text
from .registry import report
from .tables import Tables, duck_with

_ROWS = (
    duck_with("sales")
    + """, t AS (SELECT *, CASE WHEN ts IS NOT NULL AND ts <> '' THEN
      CASE WHEN length(regexp_replace(ts, '\\.\\d+', '', 'g')) <= 10
           THEN CAST(trunc(CAST(ts AS DOUBLE) * 1000) AS BIGINT) ELSE CAST(trunc(CAST(ts AS DOUBLE)) AS BIGINT) END
      ELSE insert_time END AS event_ms FROM sales),
r AS (SELECT id, product_id, order_id, op, CAST(total_amount AS DECIMAL(18, 2)) AS amount, event_ms,
      event_ms // 86400000 * 86400000 AS day0 FROM t WHERE op IN ('r', '+I', '+U')),
fs AS (SELECT day0, min(event_ms) // 600000 * 600000 + 600000 AS first_end FROM r GROUP BY day0),
win AS (SELECT day0, unnest(generate_series(first_end, day0 + 86400000, 600000)) AS wend FROM fs)
"""
)


def _rows(t: Tables):
    return gmv.sales_rows(t.sales)


def _utc(c):
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def _at(ms: str):
    return times.local_datetime(ms, "UTC")


@report(
    "p15_sales_event_time",
    _ROWS + "SELECT order_id, event_ms FROM t",
)
def p15(t):
    return gmv.sales_rows(t.sales, ops=None).select("order_id", "event_ms")


@report(
    "p14_sales_of_a_day",
    _ROWS + "SELECT order_id, op, event_ms FROM r WHERE day0 = 1704844800000",
)
def p14(t):
    return gmv.sales_rows(t.sales, day="2024-01-10").select("order_id", "op", "event_ms")


# The check sums every window from its sales, without slices.
_NAIVE = """
g AS (SELECT win.day0, wend, sum(amount) AS gmv FROM win JOIN r ON r.day0 = win.day0 AND event_ms < wend GROUP BY 1, 2)
"""


def _naive_ids(column: str, name: str) -> str:
    return f"""
{name}s AS (SELECT win.day0, wend, {column} AS id, sum(amount) AS total FROM win
   JOIN r ON r.day0 = win.day0 AND event_ms < wend GROUP BY 1, 2, 3),
{name} AS (SELECT *, row_number() OVER (PARTITION BY day0, wend ORDER BY total DESC, id) AS rn FROM {name}s),
{name}l AS (SELECT day0, wend, string_agg(id, ',' ORDER BY rn) AS ids FROM {name} WHERE rn <= 5 GROUP BY 1, 2)
"""


@report(
    "w8_a17_cumulative_gmv",
    _ROWS
    + ","
    + _NAIVE
    + f"SELECT {utc_text('day0')} AS window_start, {utc_text('wend')} AS window_end, CAST(gmv AS DOUBLE) AS gmv FROM g",
)
def w8(t):
    totals = gmv.cumulative_totals(_rows(t))
    return totals.select(
        _at("window_start").alias("window_start"),
        _at("window_end").alias("window_end"),
        F.col("gmv").cast("double").alias("gmv"),
    )


def _by(id_col: str):
    def build(t):
        sums = gmv.cumulative_sums_by(_rows(t), id_col)
        return sums.select(
            _at("window_start").alias("window_start"),
            _at("window_end").alias("window_end"),
            id_col,
            F.col("total").cast("double").alias("total"),
        )

    return build


def _top(id_col: str):
    def build(t):
        top = gmv.cumulative_top(_rows(t), id_col)
        return top.select(
            _at("window_start").alias("window_start"),
            _at("window_end").alias("window_end"),
            id_col,
            F.col("total").cast("double").alias("total"),
            "rn",
        )

    return build


for _column in ("id", "product_id"):
    report(
        f"a18_cumulative_sum_by_{_column}",
        _ROWS
        + ","
        + _naive_ids(_column, "q")
        + f"""SELECT {utc_text('day0')} AS window_start, {utc_text('wend')} AS window_end, id AS {_column},
CAST(total AS DOUBLE) AS total FROM qs""",
    )(_by(_column))
    report(
        f"w1_top5_{_column}",
        _ROWS
        + ","
        + _naive_ids(_column, "q")
        + f"""SELECT {utc_text('day0')} AS window_start, {utc_text('wend')} AS window_end, id AS {_column},
CAST(total AS DOUBLE) AS total, CAST(rn AS INTEGER) AS rn FROM q WHERE rn <= 5""",
    )(_top(_column))


@report(
    "a19_top5_lists",
    _ROWS
    + ","
    + _naive_ids("id", "q")
    + f"SELECT {utc_text('day0')} AS window_start, {utc_text('wend')} AS window_end, ids AS top5_ids FROM ql",
)
def a19(t):
    lists = gmv.listed(gmv.cumulative_top(_rows(t), "id"), "id", "top5_ids")
    return lists.select(
        _at("window_start").alias("window_start"),
        _at("window_end").alias("window_end"),
        "top5_ids",
    )


_REPORT = (
    _ROWS + "," + _NAIVE + "," + _naive_ids("id", "q") + "," + _naive_ids("product_id", "p")
)


@report(
    "q1_j1_gmv_topn",
    _REPORT
    + f"""SELECT CAST(CAST(make_timestamp(g.day0 * 1000) AS DATE) AS STRING) AS order_date,
 {utc_text('g.day0')} AS window_start, {utc_text('g.wend')} AS window_end, CAST(gmv AS DOUBLE) AS gmv,
 coalesce(ql.ids, '') AS top5_ids, coalesce(pl.ids, '') AS top5_product_ids
FROM g LEFT JOIN ql ON ql.day0 = g.day0 AND ql.wend = g.wend LEFT JOIN pl ON pl.day0 = g.day0 AND pl.wend = g.wend""",
)
def q1(t):
    return gmv.gmv_topn(_rows(t)).withColumns(
        {
            "window_start": _utc(F.col("window_start")),
            "window_end": _utc(F.col("window_end")),
            "gmv": F.col("gmv").cast("double"),
        }
    )


@report(
    "p16_gmv_report_rows",
    _REPORT
    + f"""SELECT CAST(CAST(make_timestamp(g.day0 * 1000) AS DATE) AS STRING) AS order_date,
 {utc_text('g.day0')} AS window_start_time, {utc_text('g.wend')} AS window_end_time, CAST(gmv AS DOUBLE) AS gmv_total,
 coalesce(ql.ids, '') AS top_user_ids, coalesce(pl.ids, '') AS top_product_ids,
 CAST(CAST(make_timestamp(g.wend * 1000) AS DATE) AS STRING) AS ds
FROM g LEFT JOIN ql ON ql.day0 = g.day0 AND ql.wend = g.wend LEFT JOIN pl ON pl.day0 = g.day0 AND pl.wend = g.wend""",
)
def p16(t):
    return gmv.report_rows(gmv.gmv_topn(_rows(t))).withColumns(
        {
            "window_start_time": _utc(F.col("window_start_time")),
            "window_end_time": _utc(F.col("window_end_time")),
            "gmv_total": F.col("gmv_total").cast("double"),
            "ds": F.col("ds").cast("string"),
        }
    )
