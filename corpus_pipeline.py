"""The corpus pipeline: each stage works on what the one before has kept.

1. ``quality``: texts that the scorer rejects go.
2. ``ngram_jaccard``: of texts that n-gram similarity joins into a group one stays.
3. ``decontaminate``: texts of which benchmark windows make up a twentieth or more go.
4. ``personal_data``: personal data are replaced by their kind in brackets.
5. ``mix``: the documents that the mix takes words of, with the slots that hold them.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shopwake.llm.decontamination import benchmark_hits, contaminated
from shopwake.llm.mixing import mix, words_in
from shopwake.llm.ngram_join import without_copies
from shopwake.llm.pii import masked, personal_data
from shopwake.llm.quality import quality
from shopwake.llm.tables import Scratch, unpacked
from shopwake.session import apply_runtime_conf


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of a half or more."""
    return unpacked(quality(docs).where("score >= 0.5"), docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(hits.where(~contaminated()), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the new text."""
    clean = personal_data(docs).withColumn("text", masked(F.col("text"), F.col("spans")))
    out = unpacked(clean, docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and text of what the mix takes, with size, source_size,
    target, taken and ``pieces`` (slot, from_word, to_word)."""
    key = ["doc_id", "source", "text_hash"]
    number = F.row_number().over(W.partitionBy(*key).orderBy("size")).alias("number")
    plan = mix(docs).select("*", number).where("taken > 0")
    plan = plan.select(*(F.col(c).alias(f"m_{c}") for c in (*key, "number")), "source_size", "target", "taken", "pieces")
    rows = docs.select("doc_id", "lang", F.col("source").cast("string").alias("source"), "text", F.xxhash64("text").alias("text_hash"), words_in(F.col("text")).alias("size"))
    rows = rows.select("*", number)
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in (*key, "number")]
    return rows.join(plan, same[0] & same[1] & same[2] & same[3]).select(
        "doc_id", "lang", "source", "text", "size", "source_size", "target", "taken", "pieces"
    )


STAGES = [
    ("quality", good_texts),
    ("ngram_jaccard", one_of_each),
    ("decontaminate", without_benchmark),
    ("personal_data", without_personal_data),
    ("mix", mixed),
]

# A scorer fitted by descent and a tagger decide here, which SQL does not express;
# tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    apply_runtime_conf(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
