"""Session settings shared by every job."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Settings that change how a plan runs, never what it returns.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # GBK and characters that Latin-1 lacks, for text that was decoded wrongly
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime-changeable options on an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


PARQUET_CODEC = "spark.sql.parquet.compression.codec"


def compress_repeats(spark: SparkSession) -> None:
    """Parquet files that the session writes from now on are compressed with zstd,
    unless the caller has chosen a codec.

    For rows that repeat a long text, as the pairs of a comment do: snappy looks back 64 KB at most.
    """
    if spark.conf.get(PARQUET_CODEC, None) is None:
        spark.conf.set(PARQUET_CODEC, "zstd")


def build_session(
    app_name: str = "shopwake", master: str | None = None, **conf: str
) -> SparkSession:
    """Session builder; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(RUNTIME_CONF)
    settings["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB_PROVIDER
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_written: list[str] = []
_local_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the checkpoint folder that the session names; the
    driver and all executors must see the same place.

    Where none is named, a session of one process (``local``, ``local[n]``) gets a
    temporary one; any cluster, ``local-cluster`` too, must name its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _local_roots[context.applicationId]
    path = f"{root.rstrip('/')}/{purpose}-{os.urandom(6).hex()}"
    _written.append(path)
    return path


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def delete_shared(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete what operators have written below the checkpoint folder so far.

    Results are lazy, so a job calls this when it has written its own.
    """
    while _written:
        delete_shared(spark, _written.pop())
