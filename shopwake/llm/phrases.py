"""Queries op11 and op12: collocations and license scans."""

from __future__ import annotations

from .collocations import collocations
from .license_scan import K, SLACK, TEMPLATES, document_licenses
from .queries import query

COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
k AS (SELECT lang, w, k FROM w, range(1, 4) z(k)),
i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k),
f AS (SELECT lang, k AS size, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
x AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp
        FROM kept, range(1, 3) z(k) WHERE k < size),
s AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r,
             (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""

_TEMPLATES = ",\n  ".join(f"({i}, '{t.label}', {str(t.base).upper()}, {t.share}::DOUBLE, '{t.text}')" for i, t in enumerate(TEMPLATES))
LICENSE_SQL = rf"""
WITH tl(template, label, base, least, phrase) AS (VALUES
  {_TEMPLATES}),
ts AS (SELECT *, string_split(phrase, ' ') AS tw FROM tl),
tg AS (SELECT template, p - 1 AS q, array_to_string(tw[p : p + {K - 1}], ' ') AS gram
       FROM (SELECT template, tw, unnest(range(1, len(tw) - {K - 2})) AS p FROM ts)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT r, p - 1 AS pos, array_to_string(w[p : p + {K - 1}], ' ') AS gram
       FROM (SELECT r, w, unnest(range(1, len(w) - {K - 2})) AS p FROM d)),
v AS (SELECT r, template, q, pos, pos - q AS diagonal FROM dg JOIN tg USING (gram)),
g AS (SELECT DISTINCT r, template, diagonal FROM v),
h AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > CASE WHEN base THEN 0 ELSE {SLACK} END THEN 1 ELSE 0 END AS cut
      FROM g JOIN ts USING (template) WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
i AS (SELECT r, template, diagonal, sum(cut) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM h),
c AS (SELECT r, template, span, count(DISTINCT q + x) AS covered, min(pos) AS first_word
      FROM v JOIN i USING (r, template, diagonal), range({K}) z(x) GROUP BY ALL),
s AS (SELECT r, label, base, first_word, covered / CAST(len(tw) AS DOUBLE) AS share,
             covered / CAST(len(tw) AS DOUBLE) >= least AS verified FROM c JOIN ts USING (template)),
a AS (SELECT r, count(*) FILTER (base AND verified) AS n_base, min(first_word) FILTER (base AND verified) AS first_word,
             max(first_word) FILTER (base AND verified) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND verified) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(share) AS score
      FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN a USING (r)
"""


@query("op11_collocations", "documents", COLLOCATION_SQL)
def _collocations(rows, spark, sf_dir):
    return collocations(rows)


@query("op12_license_scan", "documents", LICENSE_SQL)
def _licenses(rows, spark, sf_dir):
    return document_licenses(rows)
