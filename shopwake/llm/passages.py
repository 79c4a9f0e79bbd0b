"""Queries op3 and op5: benchmark words and repeated bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontamination import benchmark_hits, contaminated, n_hit
from .queries import query
from .suffix_dedup import repeated_bytes

BENCHMARK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
cut AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM cut),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
found AS (
  SELECT q.r, q.p, q.n, x.item
  FROM (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM places) q
  JOIN windows x ON q.n = x.n AND q.s = x.s),
words AS (SELECT r, count(DISTINCT k) AS h FROM (SELECT r, unnest(range(p, p + n)) AS k FROM found) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM found GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.h, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
       sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(words.h, 0) > 0 AND 20 * coalesce(words.h, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN ids ON d.r = ids.r
"""


@query("op3_benchmark_words", "documents", BENCHMARK_SQL)
def _benchmark(rows, spark, sf_dir):
    hits = benchmark_hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


@query("op5_repeated_bytes", "documents")
def _repeats(rows, spark, sf_dir):
    sizes = F.zip_with("highs", "lows", lambda high, low: high - low)
    return repeated_bytes(rows).select(
        "doc_id", "n_bytes", F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x).alias("n_removed"),
        F.size("lows").cast("long").alias("n_spans"), "kept_sha256",
    )
