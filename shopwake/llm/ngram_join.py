"""Similarity join of texts on word n-gram sets: MinHash bands, exact check.

Texts of one n-gram set form a class. Classes that agree in a band of MinHash
values are candidates; candidates that hang together are compared on their
full sets, tile by tile, so no list of pairs is built: a tile gives one row per
linked class with its number of links and a root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import components
from .groups import LINKS, emit, groups
from .tables import Scratch
from .text import Words, distinct, flat, list_array, mix, shingles, slices, stream

TILE = 1024  # classes compared at once with as many others
COLUMNS = 4096  # n-grams of a tile counted at once
SIEVE_WORDS = 1 << 20  # of 64 bits


def banding(similarity: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): as many bands of ``rows`` values as it takes to find a
    pair just at ``similarity`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(Words(*flat(batch.column("text"))), words))


def _signatures(words: int, bands: int, rows: int):
    """doc_id, text key, set key (null: no words) and one hash per band."""
    odd = stream(3, bands * rows) | np.uint64(1)
    plus = stream(4, bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, at = _sets(batch, words)
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            begin = at[:-1][some]
            keys = [hashlib.md5(values[at[i] : at[i + 1]].tobytes()).digest() if sizes[i] else None for i in range(batch.num_rows)]
            band = np.zeros((len(some), bands), np.uint64)
            if len(some):
                for j in range(bands * rows):
                    x = values * odd[j] + plus[j]
                    least = np.minimum.reduceat(x ^ (x >> np.uint64(29)), begin)
                    band[:, j // rows] = mix(band[:, j // rows] + least + np.uint64(j // rows + 1))
            lengths = np.zeros(batch.num_rows, np.int64)
            lengths[some] = bands
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(keys, pa.binary()),
                 list_array(band.ravel(), np.concatenate([[0], np.cumsum(lengths)]))],
                ["doc_id", "t1", "t2", "set_key", "bands"],
            )

    return run


def _full_sets(words: int, sieve):
    """Sets of the rows whose hash the sieve may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h = batch.column("h").to_numpy().view(np.uint64)
            bits = sieve.value[(h % np.uint64(SIEVE_WORDS)).astype(np.int64)] >> (h >> np.uint64(58))
            batch = batch.filter(pa.array((bits & np.uint64(1)).astype(bool)))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "t1", "t2")), list_array(*_sets(batch, words))], ["doc_id", "t1", "t2", "grams"]
                )

    return run


def _sieve(rows: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``rows``: 8 MB at most, whatever their number. With
    very many rows most bits are set and it lets through more; a join follows."""
    h = F.xxhash64("least", "t1")
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")
    words = rows.select(h.alias("h")).select(F.expr(f"pmod(h, {SIEVE_WORDS})").alias("word"), bit.alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SIEVE_WORDS, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, by products of 0/1 columns."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float64)
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def _links(similarity: float):
    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n, tile = (table.column(c).to_numpy() for c in ("id", "n", "tile"))
        if len(ids) < 2:
            return
        sets = [np.asarray(g) for g in table.column("grams").to_numpy()]
        sizes = np.array([len(s) for s in sets])
        common = shared(sets)
        near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        near = np.triu(near, 1)
        if table.column("cross")[0].as_py():
            near &= tile[:, None] != tile[None, :]
        left, right = np.nonzero(near)
        if len(left):
            yield emit(ids, n, left, right, np.ones(len(left), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "pair"):
            yield from compare(group)

    return run


def _tiles(members: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, n, cand, tile, pair, cross): the pairs of tiles each class is in.

    A candidate group of up to ``TILE`` classes is one tile. A larger one is cut by
    powers of the similarity in set size, since linked sets differ by one such step at
    most, and each step by hash into tiles; a tile meets itself, the others of its
    step and those of the next.
    """
    sizes = scratch.keep(members.groupBy("cand").agg(F.count("*").alias("m")), "groups")
    small = members.join(sizes.where(F.col("m") <= TILE), "cand").select(
        "id", "n", "cand", F.lit(0).cast("long").alias("tile"), F.xxhash64("cand").alias("pair"), F.lit(False).alias("cross")
    )
    big = scratch.keep(members.join(sizes.where(F.col("m") > TILE), "cand").withColumn(
        "step", F.floor(F.log("size") / F.lit(-math.log(similarity)) + 1e-9).cast("int")).drop("m"), "big")
    steps = scratch.keep(big.groupBy("cand", "step").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "steps")
    around = [steps.select("cand", (F.col("step") - d).alias("step"), F.col("tiles").alias(f"at{d}")) for d in (-1, 0, 1)]
    for near in around:
        big = big.join(scratch.keep(near, "near"), ["cand", "step"], "left")
    big = big.na.fill(0, ["at-1", "at1"]).withColumn("own", F.expr("cast(pmod(xxhash64(id), at0) as int)"))
    pairs = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("at0") - 1), lambda j: F.struct(
            F.col("step").alias("s1"), F.least("own", j).alias("i1"), F.col("step").alias("s2"), F.greatest("own", j).alias("i2"))),
        F.when(F.col("at1") > 0, F.transform(F.sequence(F.lit(0), F.col("at1") - 1), lambda j: F.struct(
            F.col("step").alias("s1"), F.col("own").alias("i1"), (F.col("step") + 1).alias("s2"), j.alias("i2")))).otherwise(F.array()),
        F.when(F.col("at-1") > 0, F.transform(F.sequence(F.lit(0), F.col("at-1") - 1), lambda j: F.struct(
            (F.col("step") - 1).alias("s1"), j.alias("i1"), F.col("step").alias("s2"), F.col("own").alias("i2")))).otherwise(F.array()),
    )
    big = big.withColumn("p", F.explode(pairs)).select(
        "id", "n", "cand", F.xxhash64("step", "own").alias("tile"), F.xxhash64("cand", "p.s1", "p.i1", "p.s2", "p.i2").alias("pair"),
        ((F.col("p.s1") != F.col("p.s2")) | (F.col("p.i1") != F.col("p.i2"))).alias("cross"),
    )
    return small.unionByName(big)


def _classes(docs: DataFrame, words: int, similarity: float, recall: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(texts, classes): per row its keys; per class its group and its links."""
    bands, rows = banding(similarity, recall)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("t2"))
    kind = dict(docs.dtypes)["doc_id"]
    texts = scratch.keep(
        keyed.mapInArrow(_signatures(words, bands, rows), f"doc_id {kind}, t1 long, t2 long, set_key binary, bands array<long>"), "signatures"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"))
    classes = texts.where("set_key is not null").groupBy("set_key").agg(
        F.count("*").alias("n"), first.alias("least"), F.first("bands").alias("bands")
    )
    classes = scratch.keep(
        classes.select("set_key", "n", "bands", F.col("least.doc_id").alias("least"), F.col("least.t1").alias("t1"), F.col("least.t2").alias("t2"),
                       F.monotonically_increasing_id().alias("id")), "classes"
    )
    spots = classes.select("id", F.posexplode("bands").alias("at", "hash")).select("id", F.xxhash64("at", "hash").alias("spot"))
    heads = scratch.keep(spots.groupBy("spot").agg(F.min("id").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m"), "heads")
    edges = spots.join(heads, "spot").where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    cands = scratch.keep(components(edges, scratch).select(F.col("node").alias("id"), F.col("component").alias("cand")), "candidates")
    asked = scratch.keep(cands.join(classes.select("id", "n", "least", "t1", "t2"), "id"), "asked")
    # The sets of one row of each candidate class; texts are not shuffled for them.
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(asked))
    found = keyed.withColumn("h", F.xxhash64("doc_id", "t1")).mapInArrow(_full_sets(words, sieve), f"doc_id {kind}, t1 long, t2 long, grams array<long>")
    one = [F.col("doc_id").eqNullSafe(F.col("least")), F.col("t1") == F.col("c1"), F.col("t2") == F.col("c2")]
    found = found.join(asked.select("id", "least", F.col("t1").alias("c1"), F.col("t2").alias("c2")), one[0] & one[1] & one[2])
    sets = scratch.keep(found.select("id", "grams").dropDuplicates(["id"]), "sets")
    members = scratch.keep(asked.select("id", "n", "cand").join(sets.select("id", F.size("grams").alias("size")), "id"), "members")
    tiles = _tiles(members, similarity, scratch).join(sets, "id")
    links = scratch.keep(tiles.repartition("pair").sortWithinPartitions("pair", "cand").mapInArrow(_links(similarity), LINKS), "links")
    parts = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.drop("bands").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = scratch.keep(named.withColumn("component", F.coalesce("component", "id")), "named")
    # Ids may be null or repeat, so a group's first row is told by id and text.
    names = named.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "t1", "t2")).alias("head"))
    named = named.join(scratch.keep(names, "names"), "component").select(
        "set_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("head.least").alias("class_id"),
        F.col("head.t1").alias("h1"), F.col("head.t2").alias("h2"),
    )
    return texts.drop("bands"), scratch.keep(named, "results")


def similar_texts(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, class_id and n_links.

    Two documents are linked if the Jaccard similarity of their sets of ``words``
    consecutive words is ``similarity`` or more (a shorter text has one n-gram of
    all its words); a pair just there is found with probability ``recall``. Texts
    of equal sets always link. ``n_links`` counts linked documents, copies and
    repeated rows each; ``class_id`` is the least doc_id that links reach. Null, empty and
    word-less texts link with nothing: their class is their own doc_id. A null
    doc_id names a class only if all ids of the class are null. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    texts, classes = _classes(docs.select("doc_id", "text"), words, similarity, recall, scratch)
    out = texts.join(classes, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def without_copies(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The documents with one of each class of ``similar_texts``, all columns.

    The least doc_id stays (of rows equal in id and text, one); texts without
    words all stay. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    texts, classes = _classes(docs.select("doc_id", "text"), words, similarity, recall, scratch)
    # Rows are told by hashes of id and text, so that one shuffle serves join and window.
    row = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("k1"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("k2"))
    heads = classes.select(F.xxhash64("class_id", "h1").alias("k1"), F.col("h2").alias("k2"), F.lit(False).alias("all")).distinct()
    bare = texts.where("set_key is null").select(F.xxhash64("doc_id", "t1").alias("k1"), F.col("t2").alias("k2"), F.lit(True).alias("all")).distinct()
    keys = scratch.keep(heads.unionByName(bare), "kept")
    number = F.row_number().over(W.partitionBy("k1", "k2").orderBy("all"))
    return row.join(keys, ["k1", "k2"]).withColumn("n", number).where("all or n = 1").select("row.*")
