"""Near-duplicate vectors: sign hashing in several tables, exact cosines.

Each table hashes a vector to the signs of its products with random hyperplanes.
Vectors of equal code in some table are compared by exact cosine. A pair that
meets in several tables is counted in the first of them, which both codes
show, so no list of pairs is ever built: a group gives one row per linked
vector with its number of links and a root, and the roots are joined into
components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .components import components
from .groups import LINKS, emit, groups
from .tables import Scratch

TILE = 512  # vectors of one bucket compared at once with as many others


def valid(vector: Column) -> Column:
    """True if there are components, all finite, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _components(rows: DataFrame, vector: str) -> Column:
    """The vector as floats if it holds floats, else as doubles."""
    held = rows.schema[vector].dataType
    single = isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType)
    return F.col(vector).cast("array<float>" if single else "array<double>")


def shape(rows: int, threshold: float, loss: float, bucket: int) -> tuple[int, int]:
    """Planes per table, so that a bucket of unrelated vectors holds about
    ``bucket``, and tables, so that a pair at the threshold is missed with
    probability ``loss`` at most (closer pairs more seldom)."""
    same = 1 - math.acos(threshold) / math.pi
    planes = min(30, max(2, round(math.log2(max(2, rows / bucket)))))
    return planes, math.ceil(math.log(loss) / math.log(1 - same**planes))


def _signs(planes: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("vector").to_numpy(zero_copy_only=False)
            dims = np.array([len(v) for v in vectors])
            codes = np.zeros((len(vectors), tables), np.int64)
            for dim in np.unique(dims):
                if dim not in held:
                    held[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), planes * tables))
                at = np.flatnonzero(dims == dim)
                up = np.stack([vectors[i] for i in at]).astype(np.float64) @ held[dim] > 0
                codes[at] = (up.reshape(len(at), tables, planes) @ (1 << np.arange(planes))) + (int(dim) << 32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), flat], ["id", "codes"])

    return run


def _links(threshold: float):
    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table.column(c).to_numpy() for c in ("id", "n", "tile")}
        if len(cols["id"]) < 2:
            return
        at = int(table.column("at")[0].as_py())
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        vectors = np.stack(table.column("vector").to_numpy()).astype(np.float64)
        codes = np.stack(table.column("codes").to_numpy())
        unit = vectors / np.linalg.norm(vectors / np.abs(vectors).max(axis=1, keepdims=True), axis=1, keepdims=True)
        unit /= np.abs(vectors).max(axis=1, keepdims=True)
        if one == two:
            left, right = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
        else:
            a, b = np.flatnonzero(cols["tile"] == one), np.flatnonzero(cols["tile"] == two)
            left, right = np.nonzero(unit[a] @ unit[b].T >= threshold)
            left, right = a[left], b[right]
        if not len(left):
            return
        counted = np.ones(len(left), bool)
        for t in range(at):  # pairs that an earlier table has too count there
            counted &= codes[left, t] != codes[right, t]
        yield emit(cols["id"], cols["n"], left, right, counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "pair"):
            yield from compare(group)

    return run


def near_vectors(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, loss: float = 5e-4, bucket: int = 64, seed: int = 7
) -> DataFrame:
    """One row per vector: the key, ``n_links``, ``component_id`` and ``kept``.

    Links are pairs of cosine ``threshold`` or more in double precision (components travel in their
    own type, which is exact); a pair
    just there is found with probability 1 - ``loss``. Equal vectors are one
    class and link with each other. Vectors that are null, empty, zero or hold
    null or non-finite components, and vectors of another length, link with
    nothing; such a row is a component of its own. Rows of one key count each for
    itself; a row whose key is null has the component of its class, named by the
    least key there, or null. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    table = rows.select(F.col(key).alias("key"), _components(rows, vector).alias("vector"))
    table = table.withColumn("ok", valid(F.col("vector")))
    same = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(seed), "vector", F.size("vector")).alias("h2")]
    rows_in = table.select("key", "ok", *same)
    classes = table.where("ok").select("key", "vector", *same).groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("key").alias("least"), F.first("vector").alias("vector")
    )
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    planes, tables = shape(classes.count(), threshold, loss, bucket)
    codes = scratch.keep(classes.select("id", "vector").mapInArrow(_signs(planes, tables, seed), "id long, codes array<long>"), "codes")
    spots = codes.select("id", F.posexplode("codes").alias("at", "code"))
    sizes = spots.groupBy("at", "code").agg(F.count("*").alias("m")).where("m > 1")
    sizes = scratch.keep(sizes.withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int")).drop("m"), "sizes")
    met = spots.join(sizes, ["at", "code"]).withColumn("tile", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    # A tile meets itself and every other tile of its bucket once.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other"))
    met = met.select("id", "at", "tile", "one", "two", F.xxhash64("at", "code", "one", "two").alias("pair"))
    # A comparison asks for the codes of earlier tables alone.
    wide = met.join(classes.select("id", "n", "vector"), "id").join(codes, "id").withColumn("codes", F.slice("codes", F.lit(1), F.col("at")))
    found = scratch.keep(
        wide.repartition("pair").sortWithinPartitions("pair", "at", "one", "two").mapInArrow(_links(threshold), LINKS), "links"
    )
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.drop("vector").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    classes = scratch.keep(classes.withColumn("component", F.coalesce("component", "id")), "named")
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = scratch.keep(classes.join(scratch.keep(names, "names"), "component").select(
        "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.lit(True).alias("ok")), "results")
    out = rows_in.join(classes, ["h1", "h2", "ok"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
