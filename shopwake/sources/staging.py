"""Written intermediate tables: recompute-free and safe when executors go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shared_dir


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Used where two branches need an expensive result: later readers prune
    columns from the table instead of computing it again. ``session.clear_shared``
    deletes it when the job's result has been written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
