"""Relational and CSV sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def lower_camel(name: str) -> str:
    """``UPPER_UNDERSCORE`` to ``lowerCamel``."""
    head, *rest = name.lower().split("_")
    return head + "".join(part.capitalize() for part in rest)


def renamed_lower_camel(df: DataFrame) -> DataFrame:
    return df.toDF(*[lower_camel(c) for c in df.columns])


def jdbc_options(
    url: str,
    query: str | None = None,
    table: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    **connection: str,
) -> dict[str, str]:
    """Options of a relational read.

    A large table should name a ``partition_column`` with its bounds, or one
    task reads everything.
    """
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    options = {"url": url, **connection}
    split = partition_column is not None
    if split and (bounds is None or partitions is None):
        raise ValueError("a partition column needs bounds and a partition count")
    if query is not None and split:
        options["dbtable"] = f"({query}) AS q"
    elif query is not None:
        options["query"] = query
    else:
        options["dbtable"] = table
    if split:
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return options


def query_rows(spark: SparkSession, options: dict[str, str], camel: bool = False) -> DataFrame:
    """Rows of a relational query; columns carry their aliases."""
    rows = spark.read.format("jdbc").options(**options).load()
    return renamed_lower_camel(rows) if camel else rows


def snapshot(rows: DataFrame, source: dict[str, str]) -> DataFrame:
    """Table rows as the opening events of a change feed."""
    from ..operators.changes import envelopes

    return envelopes(rows, "r", source, F.lit(0).cast("bigint"))


def user_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.USER_INFO_BASE, quote='"', escape='"')
