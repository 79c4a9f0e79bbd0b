"""Tables an operator writes for itself, and rows that pass through Arrow whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import shared_dir


class Scratch:
    """Written tables cut the lineage, outlive executors and are read with
    column pruning. ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = shared_dir(spark, purpose)
        self.names: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.names)}"
        self.names.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def mark(self) -> int:
        return len(self.names)

    def drop(self, begin: int, end: int) -> None:
        """Remove the tables kept from ``begin`` up to ``end``."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.names[begin:end]:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def packed(docs: DataFrame) -> DataFrame:
    """(_row, text): all other columns in a struct, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(F.lit(True).alias("_"), *others).alias("_row"), F.col("text").cast("string").alias("text"))


def unpacked(rows: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The packed ``columns`` again, in their order, and ``more``."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns), *more)


def with_fields(rows: DataFrame, fields: str) -> T.StructType:
    """Schema of packed rows with further fields, given as DDL."""
    return T.StructType([*rows.select("_row", "text").schema.fields, *T.StructType.fromDDL(fields).fields])


def sample(rows: DataFrame, key: Column, n: int, total: int | None = None) -> DataFrame:
    """The ``n`` rows of least ``key``, an even 64-bit hash, with it as ``tie``.

    Rows above a bound that about 2 n rows meet are left out before they are
    ordered, so what the one ordering task reads does not grow with the input.
    """
    total = rows.count() if total is None else total
    tied = rows.withColumn("tie", key)
    if total > 2 * n:
        tied = tied.where(F.col("tie") <= int(2 * n / total * 2**64) - 2**63)
    return tied.orderBy("tie").limit(n)


def sample_each(rows: DataFrame, by: str, key: Column, n: int) -> tuple[DataFrame, dict]:
    """About ``n`` distinct rows at most of each value of ``by``, those of least ``key``, an
    even 64-bit hash of whole rows, with it as ``tie``; and the number of rows of each value.

    Distinct keys are counted in steps of a sixteenth of a power of two; the last
    step of a value that keeps within ``n`` is its bound, the first one at least. All its rows are
    given if they are no more; repeated rows are given once.
    """
    tied = rows.withColumn("tie", key)
    step = F.floor(F.log2(F.col("tie").cast("double") + 2.0**63 + 1) * 16)
    counts = tied.groupBy(by, "tie").count().groupBy(by, step.alias("step")).agg(F.sum("count").alias("rows"), F.count("*").alias("ties"))
    totals: dict = {}
    ties: dict = {}
    bounds: dict = {}
    for r in counts.orderBy("step").toLocalIterator():
        totals[r[by]] = totals.get(r[by], 0) + r.rows
        ties[r[by]] = ties.get(r[by], 0) + r.ties
        if ties[r[by]] <= n or r[by] not in bounds:
            bounds[r[by]] = r.step
    bounds = rows.sparkSession.createDataFrame(list(bounds.items()), f"{by} {dict(rows.dtypes)[by]}, bound long")
    chosen = tied.join(F.broadcast(bounds), by).where(step <= F.col("bound"))
    return chosen.dropDuplicates([by, "tie"]).drop("bound"), totals
