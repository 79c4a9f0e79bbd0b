"""Language of web pages by Bayesian fusion of evidence.

Text: naive Bayes on hashed byte trigrams of the main text, fitted on labelled
documents. Markup: how often pages of a language declare each language. Address:
the shares of languages among the pages of a host, smoothed by those of its
domain, those by its suffix, and those by all pages; a page's own share is left
out. The counts behind markup and address are sums of text posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .html_text import main_text
from .tables import Scratch, sample_each
from .text import LOWER, flat, list_array, mix, slices

FIT_ROWS = 5_000  # labelled texts of each language the trigram model is fitted on
SLOTS = 1 << 13
TEMPER = 0.2  # overlapping trigrams repeat evidence
STRENGTH = 5.0  # pages that a broader level counts for
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts per text and slot."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, SLOTS), np.float32)
    c = LOWER[data].astype(np.uint64)
    slot = (mix(c[:-2] << np.uint64(16) | c[1:-1] << np.uint64(8) | c[2:]) % np.uint64(SLOTS)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    same = row[:-2] == row[2:]
    return np.bincount(row[:-2][same] * SLOTS + slot[same], minlength=n * SLOTS).reshape(n, SLOTS).astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        langs = np.array(batch.column("lang").to_pylist(), object)
        found = _trigrams(*flat(batch.column("text")))
        for lang in sorted(set(langs)):
            total = found[langs == lang].sum(axis=0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))], ["lang", "slot", "n"]
            )


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log share of each slot per language, log share of languages):
    all languages of labelled texts with their shares of those, and the trigrams
    of ``rows`` texts of each at most."""
    known = docs.where("lang is not null and text is not null")
    chosen, totals = sample_each(known, "lang", F.xxhash64(*docs.columns), rows)
    chosen = chosen.select("lang", F.col("text").cast("string").alias("text"))
    table = chosen.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(totals)
    share = np.full((SLOTS, len(langs)), 0.5)
    np.add.at(share, (table.column("slot").to_numpy(), np.searchsorted(langs, table.column("lang").to_numpy())), table.column("n").to_numpy())
    count = np.array([totals[x] for x in langs], float)
    return langs, np.log(share / share.sum(axis=0)), np.log(count / count.sum())


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, share, prior = shared.value
        for batch in slices(batches, "html", 1 << 20):
            pages = [p or "" for p in batch.column("html").to_pylist()]
            said = [m[1].lower() if (m := DECLARED.search(p)) else "" for p in pages]
            found = _trigrams(*flat(pa.array([main_text(p) for p in pages])))
            told = (found @ share) * TEMPER
            told -= told.max(axis=1, keepdims=True)
            both = told + prior
            p = np.exp(both - both.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            at = np.arange(len(pages) + 1) * len(langs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(said), list_array(told.ravel(), at, pa.float64()), list_array(p.ravel(), at, pa.float64())],
                ["page_id", "url", "declared", "told", "p"],
            )

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, url, lang, probability, and the evidence used:
    text_lang, declared and host.

    ``docs`` has text, lang and what tells its rows apart; languages are all that occur there,
    with their shares as prior, and ``FIT_ROWS`` distinct rows of least hash of each at most are fitted. Null, empty or text-less pages are judged by markup and address; an address without
    host shares the empty host; without labelled texts lang is null. Repeated rows
    give a row each and count for their host each; an empty table gives none; other
    columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "language")
    kinds = dict(pages.dtypes)
    model = fit(docs)
    langs = model[0]
    read = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    if not langs:
        return read.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), host_of(F.col("url")).alias("host"))
    rows = read.mapInArrow(_read(spark.sparkContext.broadcast(model)), f"page_id {kinds['page_id']}, url {kinds['url']}, declared string, told array<double>, p array<double>")
    host = host_of(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    rows = scratch.keep(rows, "pages")
    n = len(langs)
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    packed = F.array(*(F.col(f"s{i}") for i in range(n)))
    # One row per host, then per domain and suffix from those.
    hosts = scratch.keep(rows.groupBy("suffix", "domain", "host").agg(*sums), "hosts")
    domains = scratch.keep(hosts.groupBy("suffix", "domain").agg(*again), "domains")
    suffixes = scratch.keep(domains.groupBy("suffix").agg(*again), "suffixes")
    everywhere = suffixes.agg(*again).select(F.coalesce(packed, F.array(*[F.lit(1.0)] * n)).alias("x")).first()
    total = sum(v or 0.0 for v in everywhere.x) or 1.0
    base = F.array(*(F.lit(((v or 0.0) + 0.1) / (total + 0.1 * n)) for v in everywhere.x))

    def smoothed(counts: Column, broader: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, broader, lambda c, b: (F.greatest(c, F.lit(0.0)) + STRENGTH * b) / (F.greatest(size, F.lit(0.0)) + STRENGTH))

    suffixes = suffixes.select("suffix", smoothed(packed, base).alias("suffix_prior"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", smoothed(packed, F.col("suffix_prior")).alias("domain_prior"))
    hosts = scratch.keep(hosts.join(domains, ["suffix", "domain"]).select("host", packed.alias("counts"), "domain_prior"), "priors")
    # What pages of each language declare.
    declared = rows.groupBy("declared").agg(*sums)
    ways = declared.count()
    share = F.array(*((F.col(f"s{i}") + 0.5) / F.lit((everywhere.x[i] or 0.0) + 0.5 * ways) for i in range(n)))
    declared = scratch.keep(declared.select("declared", share.alias("markup")), "declared")
    out = rows.join(hosts, "host").join(declared, "declared")
    prior = smoothed(F.zip_with("counts", "p", lambda c, p: c - p), F.col("domain_prior"))
    out = out.withColumn("prior", prior).withColumn(
        "log", F.zip_with(F.zip_with("told", "markup", lambda t, m: t + F.log(m)), "prior", lambda x, p: x + F.log(p))
    )
    top = F.array_max("log")
    names = F.array(*(F.lit(x) for x in langs))
    norm = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return out.select(
        "page_id", "url", F.element_at(names, F.array_position("log", top).cast("int")).alias("lang"), (1 / norm).alias("probability"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"), "declared", "host",
    )
