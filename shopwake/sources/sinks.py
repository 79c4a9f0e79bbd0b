"""Sinks: topics, keyed tables, consoles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import delete_shared


def to_lines(rows: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON text per row, with an optional record key."""
    value = F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value")
    return rows.select(*([F.col(key).cast("string").alias("key")] if key else []), value)


def kafka_sink_options(servers: str, topic: str, exactly: bool = True) -> dict[str, str]:
    """All replicas acknowledge; writes are idempotent unless switched off."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.enable.idempotence": str(exactly).lower(),
    }


def write_topic(lines: DataFrame, options: dict[str, str]) -> None:
    """A bounded batch of lines to a topic."""
    lines.write.format("kafka").options(**options).save()


def stream_topic(lines: DataFrame, options: dict[str, str], checkpoint: str) -> DataStreamWriter:
    return (
        lines.writeStream.format("kafka")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def newest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, nulls first."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(newest.alias("_row")).select("_row.*")


class LineTable:
    """JSON lines, compressed, in one folder per batch: a repeated batch replaces its own lines."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        to_lines(rows).write.mode("overwrite").option("compression", "gzip").text(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.text(self.path).select("value")


class KeyedTable:
    """A table of Parquet files where a later batch replaces equal keys.

    A batch writes its own folder, overwriting only itself, so a repeated
    batch leaves the same table; nothing written before is rewritten. Reading
    keeps the newest row per key. ``order`` names the columns that tell which of
    several rows of a key in one batch is the newest; without them a batch must
    hold a key once. Without ``keys`` no row replaces another. A newest row whose ``deleted`` column is true removes its key.

    ``compact`` merges the batches so far into a level that holds each key once and no
    removed ones, then names it in ``_live``; reading takes the newest level named there
    and only the batches after it. A level counts from the moment it is named, so
    a compaction that fails half way changes nothing, and a batch
    repeated after it was merged is left out. ``vacuum`` deletes what is merged,
    once no earlier read is still running. With ``most_batches`` a batch that
    finds so many before it has them merged first.
    """

    def __init__(
        self, path: str, keys: list[str], order: list[str] | None = None, deleted: str | None = None, most_batches: int | None = None
    ):
        self.path, self.keys = path.rstrip("/"), list(keys)
        self.order, self.deleted, self.most_batches = order, deleted, most_batches

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def merged(self, spark: SparkSession) -> int:
        """The last batch that a level holds; -1 if there is no level."""
        return max((int(n) for n in self._names(spark, f"{self.path}/_live")), default=-1)

    def batches(self, spark: SparkSession) -> list[int]:
        """Batches that no level holds yet."""
        merged = self.merged(spark)
        found = (int(n.removeprefix("batch=")) for n in self._names(spark, self.path) if n.startswith("batch="))
        return sorted(n for n in found if n > merged)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if batch_id <= self.merged(spark):
            return
        if self.most_batches and sum(n < batch_id for n in self.batches(spark)) >= self.most_batches:
            self.compact(spark, batch_id)  # those before it, so that this one can be repeated
        if self.order:
            rows = newest_per_key(rows, self.keys, self.order)
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The table, or as it was ``before`` a batch that no level holds."""
        merged = self.merged(spark)
        if before is not None and before <= merged:
            raise ValueError(f"batch {before} is merged already")
        later = [n for n in self.batches(spark) if before is None or n < before]
        if merged < 0:
            rows = spark.read.option("basePath", self.path).parquet(*(f"{self.path}/batch={n}" for n in later))
        else:
            level = spark.read.parquet(f"{self.path}/_levels/{merged}")
            if not later:
                return level
            kept = level.withColumn("batch", F.lit(merged))
            rows = spark.read.option("basePath", self.path).parquet(*(f"{self.path}/batch={n}" for n in later))
            rows = rows.unionByName(kept, allowMissingColumns=True)
        newest = newest_per_key(rows, self.keys, ["batch"]).drop("batch") if self.keys else rows.drop("batch")
        if self.deleted:
            newest = newest.filter(~F.coalesce(self.deleted, F.lit(False))).drop(self.deleted)
        return newest

    def compact(self, spark: SparkSession, before: int | None = None) -> None:
        """Merge the level and the batches after it, up to one ``before`` which to stop, into a new level."""
        if later := [n for n in self.batches(spark) if before is None or n < before]:
            self.read(spark, before).write.mode("overwrite").parquet(f"{self.path}/_levels/{later[-1]}")
            name = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_live/{later[-1]}")
            name.getFileSystem(spark._jsc.hadoopConfiguration()).create(name, True).close()

    def vacuum(self, spark: SparkSession) -> None:
        """Delete batches and levels that the newest level replaces."""
        merged = self.merged(spark)
        for folder, prefix in (("", "batch="), ("_levels/", "")):
            for name in self._names(spark, f"{self.path}/{folder}"):
                number = name.removeprefix(prefix) if name.startswith(prefix) else ""
                if number.isdigit() and (int(number) < merged or int(number) == merged and prefix):
                    delete_shared(spark, f"{self.path}/{folder}{name}")
        for name in self._names(spark, f"{self.path}/_live"):
            if int(name) < merged:
                delete_shared(spark, f"{self.path}/_live/{name}")


def ordered_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in the order the table declares them."""
    return rows.select(*columns)


def jdbc_table_writer(
    options: dict[str, str], keys: list[str], columns: list[str], order: list[str]
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function appending the batch, the newest row per key by
    ``order``. The batch number goes along as ``batch_id``, so that a table keyed by
    it refuses a repeated batch and readers can tell the newest row."""

    def write(rows: DataFrame, batch_id: int) -> None:
        newest = ordered_columns(newest_per_key(rows, keys, order), columns)
        numbered = newest.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        numbered.write.format("jdbc").options(**options).mode("append").save()

    return write


def stream_table(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "update",
) -> DataStreamWriter:
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )


def console(rows: DataFrame, mode: str = "append") -> DataStreamWriter:
    return rows.writeStream.format("console").outputMode(mode)


def counted(rows: DataFrame, name: str) -> DataFrame:
    """Debug tap: row counts as observed metrics, rows unchanged."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))
