"""SQL fragments shared by the checks."""

from .tables import duck_with

LOCAL = "(make_timestamp({ms} * 1000) + INTERVAL 8 HOUR)"


def local_date(ms: str) -> str:
    return f"CAST(CAST({LOCAL.format(ms=ms)} AS DATE) AS STRING)"


def local_datetime(ms: str) -> str:
    return f"strftime({LOCAL.format(ms=ms)}, '%Y-%m-%d %H:%M:%S')"


def utc_text(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%d %H:%M:%S')"


# Logs with normalised ts (rows without ts dropped) and local calendar fields.
_NORMAL = f"""
l AS (SELECT * REPLACE (CASE WHEN ts < 1000000000000 THEN ts * 1000 ELSE ts END AS ts)
      FROM logs WHERE ts IS NOT NULL),
d AS (SELECT *, {local_date('ts')} AS log_date, {local_datetime('ts')} AS log_time,
             CAST(hour({LOCAL.format(ms='ts')}) AS INTEGER) AS hour FROM l)
"""


def logs_with(*others: str) -> str:
    """``WITH`` clause giving ``d``: the dated logs, plus other tables."""
    return duck_with("logs", *others) + ",\n" + _NORMAL


def words_with() -> str:
    """``w``: one row per cleaned search keyword."""
    return logs_with() + """,
x AS (SELECT log_id, user_id, ts, log_date, unnest(keywords) AS raw,
             generate_subscripts(keywords, 1) AS pos FROM d WHERE log_type = 'search'),
w AS (SELECT log_id, user_id, ts, log_date, pos, trim(raw) AS keyword FROM x
      WHERE trim(raw) <> '' AND trim(raw) <> 'null')
"""
