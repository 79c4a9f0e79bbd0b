"""Query op13: the Merkle manifest of the documents, checked against tampered texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .merkle import merkle_manifest
from .queries import query


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column})) || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    columns = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(map(_field, columns)) + ")"


# crc32 is worked out bit by bit: a byte is mixed in, then eight steps follow it.
MANIFEST_SQL = rf"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, *, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'),
          lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS inverse FROM documents),
leaves AS (SELECT r, doc_id, coalesce('1' || source, '0') AS s, {_leaf('text')} AS leaf,
             CASE WHEN inverse % 2 = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS found FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM leaves),
low(s, level, pos, n, h) AS (
  SELECT s, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT s, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY s, level, pos // 3, n),
t AS (SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM t
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (SELECT s, level, pos, n, h FROM low UNION ALL SELECT '', level, pos, n, h FROM high),
beside AS (SELECT a.s, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lh,
                  coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rh
           FROM nodes a JOIN nodes b ON a.s = b.s AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
way(r, s, level, pos, proof, cur) AS (
  SELECT r, s, 0, pos, '', found FROM p
  UNION ALL
  SELECT r, beside.s, way.level + 1, way.pos // 3, proof || lh || rh, sha256(lh || cur || rh)
  FROM way JOIN beside ON way.s = beside.s AND way.level = beside.level AND way.pos = beside.pos),
ended AS (SELECT r, arg_max(proof, level) AS proof, arg_max(cur, level) AS cur FROM way GROUP BY r),
up(r, level, pos, proof, cur) AS (
  SELECT e.r, 0, t.pos, e.proof, e.cur FROM ended e JOIN p USING (r) JOIN t ON t.s = p.s
  UNION ALL
  SELECT r, up.level + 1, up.pos // 3, proof || lh || rh, sha256(lh || cur || rh)
  FROM up JOIN beside ON beside.s = '' AND up.level = beside.level AND up.pos = beside.pos),
done AS (SELECT r, arg_max(proof, level) AS proof, arg_max(cur, level) AS cur FROM up GROUP BY r)
SELECT doc_id, leaf, t.h AS subroot, high.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = high.h AS verified
FROM p JOIN done USING (r) JOIN t ON t.s = p.s JOIN high ON high.n = 1
"""


@query("op13_merkle_manifest", "documents", MANIFEST_SQL)
def _manifest(rows, spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(rows, {"text": F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))})
