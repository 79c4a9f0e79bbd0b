"""Words of a lexicon inside comments.

A word matches wherever it occurs in the text. Lexicons of any size take the
same path: the bytes of the texts are tested where they lie, and a place whose first
characters are the head of some word is joined with the lengths of the words under that head, and the pieces of
these lengths with the words. Texts are not shuffled, and a place that no word begins at is no row. A head that any number of words share costs a place one
row per length, not one per word. Spark broadcasts heads and words if it has
measured them as small. A word listed with several levels has the one of
greatest weight.

Found words are ordered by level, then length, then word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions import comments as M

HEAD = 3  # first characters of a word that places are joined on
SPAN = 1 << 18  # bytes of texts that are tested at once
BYTE_SLOT_BITS = 20
SLOTS = 1 << 16
FOUND = T.ArrayType(
    T.StructType([T.StructField("word", T.StringType()), T.StructField("level", T.StringType())])
)


def read_words(spark, path: str, level: str) -> DataFrame:
    """One word per line; blank lines and ``#`` lines are skipped."""
    word = F.trim(F.col("value"))
    return (
        spark.read.text(path)
        .select(word.alias("word"), F.lit(level).alias("level"))
        .filter((F.col("word") != "") & ~F.col("word").startswith("#"))
    )


def combine(*lists: DataFrame) -> DataFrame:
    """One level per word: a list given later overrides earlier ones."""
    tagged = [w.withColumn("_load", F.lit(i)) for i, w in enumerate(lists)]
    everything = tagged[0]
    for w in tagged[1:]:
        everything = everything.unionByName(w)
    return everything.groupBy("word").agg(F.max_by("level", "_load").alias("level"))


def _order(word, level) -> tuple:
    return (-M.WEIGHTS.get(level, 0), -len(word), word)


def _sorted(found: Column) -> Column:
    """Array of (word, level) in the fixed order."""
    keyed = F.transform(
        found,
        lambda w: F.struct(
            (-M.lookup(w["level"], M.WEIGHTS, 0)).alias("weight"),
            (-F.char_length(w["word"])).alias("size"),
            w["word"].alias("word"),
            w["level"].alias("level"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda w: F.struct(w["word"].alias("word"), w["level"].alias("level")),
    )


def one_level(lexicon: DataFrame) -> DataFrame:
    """The words, each once with its level of greatest weight."""
    weight = M.lookup(F.col("level"), M.WEIGHTS, 0)
    return lexicon.filter(F.col("word") != "").groupBy("word").agg(
        F.max_by("level", F.struct(weight, F.col("level"))).alias("level")
    )


def _slot(head: Column) -> Column:
    return F.pmod(F.xxhash64(head), F.lit(SLOTS))


def _sieve(rows: DataFrame, column: str):
    """A test for the values of a column by one constant of ``SLOTS`` bits, whatever their
    number: what fails it is none of them, the rest is still joined."""
    word = F.floor(_slot(F.col(column)) / 64).cast("int").alias("at")
    bit = F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(`{column}`), {SLOTS}), 64) as int))")
    found = rows.groupBy(word).agg(F.bit_or(bit).alias("bits")).collect()
    bits = {r["at"]: r["bits"] for r in found}
    slots = F.lit([bits.get(i, 0) for i in range(SLOTS // 64)]).cast("array<bigint>")

    def known(value: Column) -> Column:
        spot = _slot(value)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int"))
        return value.isNotNull() & (F.get(slots, F.floor(spot / 64).cast("int")).bitwiseAND(bit) != 0)

    return known


def _begins(heads):
    """The number of bytes of a head that are tested, at most 8, and the slots of these bytes: one of all
    of them, and behind these slots one of the first two, for a head of one byte with any second."""
    for batch in heads:
        encoded = [h.encode()[:8] for h in batch.column(0).to_pylist()]
        codes = np.array([int.from_bytes(h, "little") for h in encoded], "<u8")
        sizes = np.array([len(h) for h in encoded], "i4")
        slots = _byte_slot(codes).astype("i8")
        own, seconds = np.repeat(np.arange(len(sizes)), np.where(sizes == 1, 256, 1)), np.arange(256) << 8
        first = [int(c) + seconds if n == 1 else [int(c) & 0xFFFF] for c, n in zip(codes, sizes)]
        first = (1 << BYTE_SLOT_BITS) + np.concatenate([np.empty(0, "i8"), *first]).astype("i8")
        sizes = np.concatenate([sizes, sizes[own]])
        yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(np.concatenate([slots, first]))], ["bytes", "slot"])


def _byte_slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BYTE_SLOT_BITS)


def _starts(known: np.ndarray, sizes: list[int], longest: int, first: np.ndarray | None = None):
    """(key, text) to (key, rest): the places of the texts at which a head may begin, each
    with as many bytes as the longest word has. The bytes of many texts are tested at once.
    ``first`` tells for each two bytes whether a head begins so; the other places are not looked at again."""
    masks = [np.uint64((1 << 8 * n) - 1) for n in sizes]
    if first is None:
        first = np.ones(1 << 16, bool)

    def places(data: np.ndarray, low: int, high: int):
        for at in range(low, high, SPAN):
            own = min(SPAN, high - at)
            block = np.zeros(own + 7, "u1")
            here = data[at : min(at + own + 7, high)]
            block[: len(here)] = here
            begun = np.flatnonzero(first.take(np.ndarray((own,), "<u2", block, 0, (1,))))
            codes = np.ndarray((own,), "<u8", block, 0, (1,))[begun]
            hit = np.zeros(len(begun), bool)
            for mask in masks:
                hit |= known[_byte_slot(codes & mask)]
            yield at + begun[hit]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1]
            if not len(texts) or ends[0] == ends[-1]:
                continue
            raw = memoryview(data)
            for found in places(np.frombuffer(data, "u1"), int(ends[0]), int(ends[-1])):
                rows = np.searchsorted(ends, found, "right") - 1
                stops = np.minimum(found + longest, ends[rows + 1])
                rests = [str(raw[a:b], "utf-8", "replace") for a, b in zip(found.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(rests, pa.string())], [batch.schema.names[0], "rest"])

    return run


def _offered(comments: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _words): the words that stand in the text; texts without any are left out."""
    words = one_level(lexicon)
    heads = words.groupBy(F.left("word", F.lit(HEAD)).alias("head")).agg(
        F.collect_set(F.char_length("word")).alias("sizes"), F.max(F.octet_length("word")).alias("bytes")
    )
    # One constant of bits, whatever the number of heads: what fails it is none of them, the rest is still joined.
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    rows = (
        heads.select("head").mapInArrow(_begins, "bytes int, slot bigint")
        .groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(bit).alias("bits"), F.collect_set("bytes").alias("bytes")).collect()
    )
    if not rows:
        return comments.limit(0).select(key, F.array().cast(FOUND).alias("_words"))
    most = heads.agg(F.max("bytes").alias("bytes"), F.collect_set(F.char_length("head")).alias("lengths")).first()
    bits = np.zeros(((1 << BYTE_SLOT_BITS) + (1 << 16)) // 64, "<i8")
    for r in rows:
        bits[r["at"]] = r["bits"]
    known = np.unpackbits(bits.view("u1"), bitorder="little").view(bool)
    sizes = sorted({n for r in rows for n in r["bytes"]})
    column = comments.schema[key]
    rest = F.col("rest")
    begun = comments.select(key, F.col(text).alias("_text")).filter(F.octet_length("_text") > 0).mapInArrow(
        _starts(known[: 1 << BYTE_SLOT_BITS], sizes, most["bytes"], known[1 << BYTE_SLOT_BITS :]), T.StructType([column, T.StructField("rest", T.StringType())])
    )
    begun = begun.select(key, "rest", F.explode(F.array(*(F.left(rest, F.lit(n)) for n in sorted(most["lengths"])))).alias("head"))
    pieces = begun.join(heads.select("head", "sizes"), "head").select(key, "rest", F.explode("sizes").alias("size"))
    met = pieces.select(key, F.left("rest", F.col("size")).alias("word")).join(words, "word")
    return met.groupBy(key).agg(F.collect_set(F.struct("word", "level")).alias("_words"))


def with_found(
    comments: DataFrame, lexicon: DataFrame, key: str, text: str = "comment"
) -> DataFrame:
    """Add ``found``: the lexicon words inside ``text`` (empty when none).

    ``key`` identifies a comment.
    """
    offered = _offered(comments, lexicon, key, text)
    found = F.coalesce(_sorted(F.col("_words")), F.array().cast(FOUND))
    return comments.join(offered, key, "left").withColumn("found", found).drop("_words")


def highest_level(found: Column) -> Column:
    """Level of the first found word, which has the greatest weight."""
    return F.coalesce(F.get(found, F.lit(0))["level"], F.lit(M.CLEAN))


def masked(text: Column, found: Column, mask_p2: bool = False) -> Column:
    """Text with the found words replaced one after another.

    P2 words stay readable unless ``mask_p2`` is set.
    """
    targets = found if mask_p2 else F.filter(found, lambda w: w["level"] != "P2")
    return F.aggregate(
        targets,
        text,
        lambda done, w: F.replace(done, w["word"], M.lookup(w["level"], M.MASKS, "*")),
    )


# Words of letters and digits, and single Chinese characters.
_SINGLE = "([一-鿿])"
_BETWEEN = "[^a-z0-9一-鿿]+"


def tokens(text: Column) -> Column:
    apart = F.regexp_replace(F.lower(text), _SINGLE, " $1 ")
    return F.array_remove(F.split(apart, _BETWEEN), "")


def found_in_tokens(
    comments: DataFrame, lexicon: DataFrame, key: str, text: str = "comment"
) -> DataFrame:
    """(key, found) by neighbouring tokens that spell a word when joined.

    Three and two joined tokens come first; single tokens count only for
    comments without such a hit. An equi-join at any lexicon size.
    """
    words = one_level(lexicon)
    known = _sieve(words, "word")
    # explode keeps the tokens a column of their own: cut once, used often
    cut = comments.select(key, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    each = cut.select(key, "_t", F.posexplode("_t").alias("_i", "_1"))
    each = each.withColumn("_2", F.concat("_1", F.get("_t", F.col("_i") + 1)))
    each = each.select(key, "_1", "_2", F.concat("_2", F.get("_t", F.col("_i") + 2)).alias("_3"))
    grams = F.array(*(F.struct(F.col(g).alias("word"), F.lit(g != "_1").alias("combined")) for g in ("_3", "_2", "_1")))
    hits = each.select(key, F.inline(grams)).filter(known(F.col("word"))).join(words, "word")
    met = F.struct("word", "level")
    both = hits.groupBy(key).agg(F.collect_set(F.when(F.col("combined"), met)).alias("_c"), F.collect_set(met).alias("_a"))
    return both.select(key, _sorted(F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.col("_a"))).alias("found"))


def with_detection(
    comments: DataFrame, lexicon: DataFrame, key: str, text: str = "comment"
) -> DataFrame:
    """``found``, ``sensitive_level``, ``is_sensitive`` and ``masked_comment``.

    Token joining is tried only where plain matching found nothing.
    """
    direct = with_found(comments, lexicon, key, text)
    spelled = found_in_tokens(comments, lexicon, key, text).withColumnRenamed("found", "_more")
    every = direct.join(spelled, key, "left")
    found = F.when(F.size("found") > 0, F.col("found")).otherwise(F.coalesce("_more", "found"))
    return (
        every.withColumn("found", found)
        .drop("_more")
        .withColumns(
            {
                "sensitive_level": highest_level(F.col("found")),
                "is_sensitive": F.size("found") > 0,
                "masked_comment": masked(F.col(text), F.col("found")),
            }
        )
    )
