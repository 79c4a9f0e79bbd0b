"""Queries op1, op4 and op10: mixing, similarity join, near-duplicate vectors."""

from __future__ import annotations

from .embedding_dedup import near_vectors
from .mixing import mix
from .ngram_join import similar_texts
from .queries import query

# The plan is redone by prefix sums; taken words follow from where a document
# lies in the shuffled order, since a source's blocks are all in the schedule
# up to its target.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss FROM sized GROUP BY source),
ranked AS (
  SELECT source, ss, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                       WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sources),
stops AS (
  SELECT *, 2 * ss / w AS ratio,
         coalesce(sum(2 * ss) OVER o, 0) AS below, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest,
         1.5::DOUBLE * sum(ss) OVER () AS wanted
  FROM ranked WINDOW o AS (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
unit AS (
  SELECT coalesce(max((wanted - below) / rest) FILTER (ratio > (wanted - below) / rest), 1e300) AS u
  FROM (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS r FROM stops)
  WHERE r = (SELECT min(r) FROM (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS r FROM stops)
             WHERE ratio > (wanted - below) / rest)),
plan AS (
  SELECT source, ss, least(2 * ss, w * u) AS target FROM ranked, unit),
placed AS (
  SELECT s.*, p.ss, p.target, floor(p.target) AS t,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, target,
       CAST(least(a + size, t) - least(a, t) + least(ss + a + size, t) - least(ss + a, t) AS BIGINT) AS taken
FROM placed
"""


@query("op1_mix_sources", "documents", MIX_SQL)
def _mixed(rows, spark, sf_dir):
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_ngram_jaccard", "documents")
def _joined(rows, spark, sf_dir):
    return similar_texts(rows)


@query("op10_embedding_near", "embeddings")
def _vectors(rows, spark, sf_dir):
    return near_vectors(rows)
