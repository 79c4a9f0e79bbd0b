"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_runtime_conf
from .tables import Tables


@dataclass(frozen=True)
class Report:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(apply_runtime_conf(spark), sf_dir))


REPORTS: dict[str, Report] = {}


def report(name: str, sql: str | None = None):
    def register(build):
        if name in REPORTS:
            raise ValueError(f"{name} registered twice")
        REPORTS[name] = Report(name, build, sql)
        return build

    return register
