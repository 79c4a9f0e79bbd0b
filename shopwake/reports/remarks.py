"""Comment reports: amounts, levels, lexicon matches, moderation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comments as M, logs as L
from ..operators import changes as C, lexicon as X, moderation
from ..sources.staging import staged
from ..plans import jobs
from .. import schemas
from .common import duck_with
from .registry import report
from .tables import LEXICON, Tables

_P = duck_with("comments")
_NOT_BLANK = "regexp_replace(comment, '\\s', '', 'g') <> ''"


def _rx(pattern: str) -> str:
    # A literal for the SQL text; \\s covers the same characters in both engines.
    return "'" + pattern.replace("'", "''") + "'"


def _offer(pattern: str) -> str:
    text = f"replace(replace(replace(regexp_extract(comment, {_rx(pattern)}, 1), ',', ''), '，', ''), ' ', '')"
    return f"CASE WHEN TRY_CAST({text} AS DOUBLE) BETWEEN 100 AND 100000 THEN TRY_CAST({text} AS DOUBLE) END"


_AMOUNT = f"""coalesce({', '.join(_offer(p) for p in M.AMOUNT_PATTERNS)},
  list_filter(list_transform(regexp_extract_all(comment, {_rx(M.AMOUNT_RUNS)}, 1), lambda x: TRY_CAST(x AS DOUBLE)),
              lambda x: x BETWEEN 100 AND 100000)[1])"""
_ROWS = (
    _P
    + f""", c AS (SELECT *, {_AMOUNT} AS mentioned FROM comments WHERE {_NOT_BLANK}),
cm AS (SELECT *, CASE WHEN regexp_matches(trim(total_amount), {_rx(M.AMOUNT_NUMBER)}) THEN TRY_CAST(trim(total_amount) AS DOUBLE)
     WHEN length(trim(total_amount)) = 4 AND NOT regexp_matches(trim(total_amount), '^[0-9]+$') AND trim(total_amount) <> 'null'
     THEN mentioned END AS amount FROM c)
"""
)


def _rows(t: Tables):
    return (
        t.comments.withColumnRenamed("doc_id", "comment_id")
        .filter(M.not_blank(F.col("comment")))
        .withColumn("amount", M.amount(F.col("total_amount"), F.col("comment")))
    )


@report("p24_amounts_in_text", _ROWS + "SELECT doc_id, mentioned FROM c")
def p24(t):
    rows = t.comments.filter(M.not_blank(F.col("comment")))
    return rows.select("doc_id", M.amount_in_text(F.col("comment")).alias("mentioned"))


@report("p23_p25_comment_amounts", _ROWS + "SELECT doc_id, amount FROM cm")
def p23(t):
    return _rows(t).select(F.col("comment_id").alias("doc_id"), "amount")


def _level_case(column: str) -> str:
    def any_of(words):
        return " OR ".join(f"contains(lower({column}), '{w}')" for w in words)

    return f"CASE WHEN {any_of(M.P1_WORDS)} THEN 'p1' WHEN {any_of(M.P2_WORDS)} THEN 'p2' ELSE 'p3' END"


@report(
    "p22_comment_levels",
    _P + f"SELECT doc_id, {_level_case('comment')} AS comment_level FROM comments",
)
def p22(t):
    return t.comments.select("doc_id", M.report_level(F.col("comment")).alias("comment_level"))


@report(
    "u1_sql_comment_level",
    _P + f"SELECT {_level_case('comment')} AS comment_level, count(*) AS comments FROM comments GROUP BY 1",
)
def u1(t):
    """The registered SQL function, called from SQL text."""
    M.register_sql_functions(t.spark)
    return t.spark.sql(
        "SELECT comment_level(comment) AS comment_level, count(*) AS comments FROM {c} GROUP BY 1",
        c=t.comments,
    )


@report("p21_repaired_names", "SELECT p_partkey, p_name AS product_name FROM part")
def p21(t):
    """GBK bytes read as Latin-1 come back as the text they were."""
    # 裤子 as it looks after the wrong decoding
    spoiled = F.concat(F.lit("裤子".encode("gbk").decode("iso-8859-1")), F.col("p_name"))
    return t.part.withColumn("spoiled", spoiled).select(
        "p_partkey",
        F.regexp_replace(M.gbk_text("spoiled"), "^裤子", "").alias("product_name"),
    )


@report(
    "q7_order_portraits",
    _P
    + f"""SELECT order_id, user_id, product_id, 'p' || doc_id AS product_name, 'c' || (doc_id % 3) AS product_class,
  CAST(strftime(CAST(ds AS DATE), '%Y%m%d') AS BIGINT) AS ds, CASE WHEN doc_id % 2 = 0 THEN ts END AS ts, comment,
  {_level_case('comment')} AS comment_level FROM comments""",
)
def q7(t):
    orders = t.comments.select(
        "order_id",
        "user_id",
        "product_id",
        F.concat(F.lit("p"), "doc_id").alias("product_name"),
        F.concat(F.lit("c"), F.col("doc_id") % 3).alias("product_class"),
        F.regexp_replace("ds", "-", "").alias("ds"),
        F.when(F.col("doc_id") % 2 == 0, F.col("ts").cast("string")).otherwise("not a number").alias("ts"),
        "comment",
    )
    return jobs.portrait_rows(orders)


_LEX = "(VALUES " + ", ".join(f"('{w}', '{v}')" for w, v in LEXICON.items()) + ") lx(word, level)"
_WEIGHT = "CASE level WHEN 'P0' THEN 3 WHEN 'P1' THEN 2 WHEN 'P2' THEN 1 ELSE 0 END"
_FOUND = f"""
hit AS (SELECT doc_id, word, level, {_WEIGHT} AS weight FROM cm JOIN {_LEX} ON contains(comment, word)),
agg AS (SELECT doc_id, string_agg(word || '(' || level || ')', ',' ORDER BY weight DESC, length(word) DESC, word) AS found,
  'P' || (3 - max(weight)) AS sensitive_level,
  list(word ORDER BY weight DESC, length(word) DESC, word) FILTER (WHERE level <> 'P2') AS w,
  list(level ORDER BY weight DESC, length(word) DESC, word) FILTER (WHERE level <> 'P2') AS v
  FROM hit GROUP BY doc_id),
det AS (SELECT cm.*, coalesce(agg.found, '') AS found, coalesce(sensitive_level, 'CLEAN') AS sensitive_level,
  agg.found IS NOT NULL AS is_sensitive,
  list_reduce(list_prepend({{'t': comment, 'w': '', 'v': ''}},
     list_transform(list_zip(coalesce(w, []), coalesce(v, [])), lambda z: {{'t': '', 'w': z[1], 'v': z[2]}})),
     lambda a, b: {{'t': replace(a.t, b.w, CASE b.v WHEN 'P0' THEN '***' ELSE '**' END), 'w': '', 'v': ''}}).t AS masked_comment,
  CASE WHEN sensitive_level <> 'P2' THEN w[1] END AS triggered_keyword
  FROM cm LEFT JOIN agg USING (doc_id))
"""


def _listed(found):
    return F.array_join(
        F.transform(found, lambda w: F.concat(w["word"], F.lit("("), w["level"], F.lit(")"))), ","
    )


def _matches(t, lexicon):
    found = F.col("found")
    return X.with_found(_rows(t), lexicon, "comment_id").select(
        F.col("comment_id").alias("doc_id"),
        _listed(found).alias("found"),
        X.highest_level(found).alias("sensitive_level"),
        X.masked(F.col("comment"), found).alias("masked_comment"),
    )


_MATCHES = _ROWS + "," + _FOUND + "SELECT doc_id, found, sensitive_level, masked_comment FROM det"


@report("j11_lexicon_matches", _MATCHES)
def j11(t):
    return _matches(t, t.lexicon())


@report("j11_lexicon_matches_join", _MATCHES)
def j11_large(t):
    """The same with 300,000 further words that no text has, and one word twice."""
    more = t.spark.range(300_000).select(
        F.concat(F.lit("th#"), F.col("id").cast("string")).alias("word"), F.lit("P2").alias("level")
    )
    again = t.spark.createDataFrame([("thorea", "P2")], "word string, level string")
    return _matches(t, t.lexicon().unionByName(more).unionByName(again))


@report(
    "j13_all_levels_masked",
    _ROWS
    + ","
    + _FOUND.replace("FILTER (WHERE level <> 'P2')", "").replace(
        "ELSE '**' END", "WHEN 'P1' THEN '**' ELSE '*' END"
    )
    + "SELECT doc_id, masked_comment FROM det",
)
def j13(t):
    matched = X.with_found(_rows(t), t.lexicon(), "comment_id")
    return matched.select(
        F.col("comment_id").alias("doc_id"),
        X.masked(F.col("comment"), F.col("found"), mask_p2=True).alias("masked_comment"),
    )


# Words that only appear when neighbouring words are joined.
_SPLIT = {"ofthe": "P0", "inthethe": "P1", "dela": "P1", "undder": "P2", "andto": "P2"}
_SLEX = "(VALUES " + ", ".join(f"('{w}', '{v}')" for w, v in _SPLIT.items()) + ") lx(word, level)"


@report(
    "j12_joined_tokens",
    _ROWS
    + f""", tk AS (SELECT doc_id, regexp_extract_all(lower(comment), '([a-z0-9]+|[一-鿿])') AS tk FROM cm),
gr AS (SELECT DISTINCT doc_id, unnest(list_concat(
   list_transform(range(1, len(tk) - 1), lambda i: {{'word': tk[i] || tk[i + 1] || tk[i + 2], 'n': 3}}),
   list_transform(range(1, len(tk)), lambda i: {{'word': tk[i] || tk[i + 1], 'n': 2}}),
   list_transform(range(1, len(tk) + 1), lambda i: {{'word': tk[i], 'n': 1}}))) AS g FROM tk),
hit AS (SELECT DISTINCT doc_id, word, level, n > 1 AS combined, {_WEIGHT} AS weight
  FROM (SELECT doc_id, g.word AS gw, g.n AS n FROM gr) JOIN {_SLEX} ON gw = word),
anyc AS (SELECT doc_id, bool_or(combined) AS c FROM hit GROUP BY doc_id)
SELECT doc_id, string_agg(DISTINCT word || '(' || level || ')', ',' ORDER BY word || '(' || level || ')') AS found
FROM hit JOIN anyc USING (doc_id) WHERE combined = c GROUP BY doc_id""",
)
def j12(t):
    lexicon = t.spark.createDataFrame(list(_SPLIT.items()), "word string, level string")
    found = X.found_in_tokens(_rows(t), lexicon, "comment_id")
    return found.select(
        F.col("comment_id").alias("doc_id"),
        F.array_join(
            F.array_sort(
                F.transform("found", lambda w: F.concat(w["word"], F.lit("("), w["level"], F.lit(")")))
            ),
            ",",
        ).alias("found"),
    )


@report(
    "s12_lexicon_levels",
    _P
    + f""", w AS (SELECT trim(p_brand) AS word, 'P1' AS level, 0 AS o FROM part UNION ALL
SELECT p_type, 'P2', 1 FROM part UNION ALL SELECT p_brand, 'P0', 2 FROM part WHERE p_size > 25)
SELECT word, arg_max(level, o) AS level FROM w GROUP BY word""",
)
def s12(t):
    def words(column, level, rows=None):
        return (t.part if rows is None else rows).select(
            F.trim(column).alias("word"), F.lit(level).alias("level")
        )

    return X.combine(
        words("p_brand", "P1"), words("p_type", "P2"), words("p_brand", "P0", t.part.filter("p_size > 25"))
    )


_HIST = """
am AS (SELECT user_id, doc_id, ts, amount, lag(amount) OVER (PARTITION BY user_id ORDER BY ts, doc_id) AS before
  FROM cm WHERE amount IS NOT NULL),
hs AS (SELECT det.*, am.before, am.amount AS a1,
  CAST(sum(CAST(is_sensitive AS INTEGER)) OVER w AS BIGINT) AS sensitive_count,
  last_value(am.amount IGNORE NULLS) OVER w AS latest,
  last_value(CASE WHEN am.amount IS NOT NULL THEN coalesce(am.before, -1) END IGNORE NULLS) OVER w AS prev
  FROM det LEFT JOIN am USING (doc_id) WINDOW w AS (PARTITION BY det.user_id ORDER BY det.ts, det.doc_id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, CASE WHEN latest IS NULL THEN NULL WHEN prev = -1 THEN latest ELSE greatest(latest, prev) END AS recent_max,
  CASE WHEN latest IS NULL THEN NULL WHEN prev = -1 THEN latest ELSE (latest + prev) / 2 END AS recent_mean FROM hs),
b AS (SELECT *, CASE WHEN recent_max > 10000 OR (prev <> -1 AND recent_mean >= 4000) THEN 'HIGH'
  WHEN recent_max > 8000 OR (prev <> -1 AND recent_mean >= 3000) THEN 'MEDIUM' ELSE 'LOW' END AS consumption_level FROM h)
"""


def _with_history(t: Tables):
    rows = X.with_found(_rows(t), t.lexicon(), "comment_id").withColumn(
        "is_sensitive", F.size("found") > 0
    )
    # Narrow rows, written once: the history reads them twice, the texts are read once.
    narrow = rows.select("comment_id", "user_id", "ts", "amount", "is_sensitive")
    return moderation.with_history(staged(narrow, "remarks"), "comment_id")


@report(
    "a20_sensitive_counts",
    _ROWS + "," + _FOUND + "," + _HIST + "SELECT doc_id, user_id, sensitive_count FROM b",
)
def a20(t):
    return _with_history(t).select(F.col("comment_id").alias("doc_id"), "user_id", "sensitive_count")


@report(
    "w4_w5_consumption_bands",
    _ROWS + "," + _FOUND + "," + _HIST + "SELECT doc_id, recent_max, recent_mean, consumption_level FROM b",
)
def w4(t):
    return _with_history(t).select(
        F.col("comment_id").alias("doc_id"), "recent_max", "recent_mean", "consumption_level"
    )


def _users(t: Tables):
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("user_name"),
        (F.col("c_nationkey") + 18).alias("age"),
        F.col("c_mktsegment").alias("user_level"),
    )


@report(
    "j10_user_defaults",
    _ROWS
    + """SELECT doc_id, coalesce(c_name, 'unknown') AS user_name, coalesce(c_nationkey + 18, 0) AS age,
  coalesce(c_mktsegment, 'UNKNOWN') AS user_level
FROM cm LEFT JOIN customer ON CAST(c_custkey AS STRING) = user_id""",
)
def j10(t):
    from ..operators import joins

    rows = _rows(t).select(F.col("comment_id").alias("doc_id"), "user_id")
    return joins.with_user_defaults(rows, _users(t)).drop("user_id")


_TOKENS = """
direct AS (SELECT doc_id, word, level FROM cm JOIN LX ON contains(comment, word)),
tk AS (SELECT doc_id, regexp_extract_all(lower(comment), '([a-z0-9]+|[一-鿿])') AS tk FROM cm
       WHERE doc_id NOT IN (SELECT doc_id FROM direct)),
gr AS (SELECT DISTINCT doc_id, unnest(list_concat(
   list_transform(range(1, len(tk) - 1), lambda i: {'word': tk[i] || tk[i + 1] || tk[i + 2], 'c': true}),
   list_transform(range(1, len(tk)), lambda i: {'word': tk[i] || tk[i + 1], 'c': true}),
   list_transform(range(1, len(tk) + 1), lambda i: {'word': tk[i], 'c': false}))) AS g FROM tk),
th AS (SELECT DISTINCT doc_id, word, level, c FROM (SELECT doc_id, g.word AS gw, g.c AS c FROM gr) JOIN LX ON gw = word),
anyc AS (SELECT doc_id, bool_or(c) AS hasc FROM th GROUP BY doc_id),
hit AS (SELECT *, WEIGHT AS weight FROM (SELECT * FROM direct UNION ALL
   SELECT DISTINCT doc_id, word, level FROM th JOIN anyc USING (doc_id) WHERE c = hasc)),
""".replace("LX", _LEX).replace("WEIGHT", _WEIGHT)


@report(
    "q5_p34_p36_moderation",
    _ROWS
    + ","
    + _TOKENS
    + _FOUND[_FOUND.index("agg AS"):]
    + ","
    + _HIST
    + """SELECT order_id, user_id, product_id, ds, CAST(ts AS STRING) AS ts, is_sensitive, sensitive_level, masked_comment,
  CASE sensitive_level WHEN 'P0' THEN 365 WHEN 'P1' THEN 60 ELSE 0 END AS ban_days,
  CASE sensitive_level WHEN 'P0' THEN 'BAN_365D_AND_SHIELD' WHEN 'P1' THEN 'BAN_60D_AND_SHIELD' ELSE 'NONE' END AS action,
  triggered_keyword, sensitive_count, consumption_level,
  CASE WHEN b.amount IS NULL THEN '0' WHEN b.amount = trunc(b.amount) THEN CAST(CAST(b.amount AS BIGINT) AS STRING)
       ELSE printf('%.2f', b.amount) END AS total_amount,
  coalesce(c_name, 'unknown') AS user_name
FROM b LEFT JOIN customer ON CAST(c_custkey AS STRING) = user_id""",
)
def q5(t):
    """The whole job; most fields come back out of its result text."""
    rows = t.comments.withColumnRenamed("doc_id", "comment_id")
    return told(jobs.moderate(rows, t.lexicon(), _users(t)))


def told(done):
    """Moderation results as columns."""
    schema = schemas.COMMENT_RESULT
    parsed = done.select(
        "is_sensitive", "masked_comment", "ban_days", "action", "sensitive_count", "user_name",
        F.from_json("result", schema).alias("r"),
        F.regexp_extract("result", '"total_amount":([0-9.]+)', 1).alias("total_amount"),
    )
    return parsed.select(
        *[F.col(f"r.{c}").alias(c) for c in ("order_id", "user_id", "product_id", "ds", "ts",
          "sensitive_level", "triggered_keyword", "consumption_level")],
        "is_sensitive", "masked_comment", "ban_days", "action", "sensitive_count", "user_name", "total_amount",
    )
