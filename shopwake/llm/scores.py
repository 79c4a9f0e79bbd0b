"""Queries op2, op6 and op9: toxicity, personal data and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .pii import listed, personal_data
from .quality import quality
from .queries import query
from .tagger import KINDS
from .toxicity import toxicity


@query("op2_toxicity", "documents")
def _toxic(rows, spark, sf_dir):
    return toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op9_quality", "documents")
def _good(rows, spark, sf_dir):
    judged = quality(rows.select("doc_id", "text"))
    return judged.select(F.col("_row.doc_id").alias("doc_id"), "score", "weak_label", (F.col("score") >= 0.5).alias("kept"))


@query("op6_personal_data", "documents")
def _personal(rows, spark, sf_dir):
    base = F.filter("spans", lambda s: ~s["added"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, kind)) for kind in KINDS]
    counts = [(F.size(kinds) - other).cast("long").alias(f"n_{kind}") for kind, other in zip(KINDS, counts)]
    return personal_data(rows.select("doc_id", "text")).select(
        F.col("_row.doc_id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
