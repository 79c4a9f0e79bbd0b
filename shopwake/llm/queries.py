"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_runtime_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register ``build(rows, spark, sf_dir)`` over ``table``."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_conf(spark)
            return build(spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register
