"""Line and table sources for batch and streaming, with their option maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

OFFSETS = ("earliest", "latest")
DISCOVERY_MS = 10_000


def kafka_options(
    servers: str, topic: str, start: str = "earliest", per_trigger: int | None = None
) -> dict[str, str]:
    """Topic to read, from its beginning or from now on."""
    if start not in OFFSETS:
        raise ValueError(f"start must be one of {OFFSETS}")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": start,
        "kafka.metadata.max.age.ms": str(DISCOVERY_MS),
        "failOnDataLoss": "false",
    }
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def as_text(raw: DataFrame) -> DataFrame:
    """Record values as text; a missing payload is dropped, not an error."""
    return raw.select(F.col("value").cast("string").alias("value")).filter(
        F.col("value").isNotNull()
    )


def kafka_lines(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return as_text(spark.readStream.format("kafka").options(**options).load())


def kafka_lines_batch(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    bounded = {**options, "startingOffsets": "earliest", "endingOffsets": "latest"}
    bounded.pop("maxOffsetsPerTrigger", None)
    return as_text(spark.read.format("kafka").options(**bounded).load())


def file_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text files as a stand-in for a topic."""
    reader = spark.readStream if streaming else spark.read
    return as_text(reader.schema("value string").text(path))


def stored_table(
    spark: SparkSession,
    folder: str,
    file_glob: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(folder)


def with_event_time(df: DataFrame, time, delay: str = "5 seconds", name: str = "event_time") -> DataFrame:
    """Event time column and its watermark; ``0 seconds`` for ordered input."""
    return df.withColumn(name, time).withWatermark(name, delay)
