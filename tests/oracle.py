"""Compare a Spark result with a DuckDB result, order-insensitively."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import duckdb

from shopwake.reports.tables import STORED


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in STORED:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def spark_bag(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return sorted(columns), bag(columns, cur.fetchall())


def differences(df, con, sql: str, show: int = 3) -> str:
    """Empty text when both agree."""
    columns, ours = spark_bag(df)
    expected_columns, theirs = duck_bag(con, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if ours == theirs:
        return ""
    extra = list((ours - theirs).items())[:show]
    missing = list((theirs - ours).items())[:show]
    return (
        f"{sum(ours.values())} rows vs {sum(theirs.values())}; columns {columns}; "
        f"only ours {extra}; only expected {missing}"
    )
