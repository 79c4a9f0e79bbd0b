"""License texts inside documents, by votes on offset diagonals.

Every place of a document where ``k`` words begin is joined by the hash of these words with the
places of the same words in the templates. A hit at word p of the document and word t of a
template votes for the diagonal p - t: a template that stands in the document whole votes along
one diagonal; a word put in or left out moves the votes to a neighbouring one. Votes are counted per
diagonal, diagonals at most ``slack`` apart are merged into a span, and a span is verified by
the share of the template's words that its votes cover.

Everything is built-in DataFrame functions; nothing runs in Python workers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .lowercase import ascii_lower

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words, once lower-cased, are what this leaves
K = 3  # words of a gram; the shortest template has as many
SLACK = 4  # words by which neighbouring diagonals of one span may differ


@dataclass(frozen=True)
class Template:
    """Words of a license; ``share`` of them must be found. Those of a base
    template must stand consecutively and count place by place."""

    label: str
    text: str
    share: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# The phrases of the contract, then opening sentences of public license notices.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        0.8,
    ),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8),
)


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """(gram, template, at, g0, g1, …): every place of every template, in template order."""
    if short := [t.text for t in templates if len(t.words) < k]:
        raise ValueError(f"templates need {k} words: {short}")
    listed = F.array(*(F.struct(F.lit(n).alias("template"), F.array(*map(F.lit, t.words)).alias("words")) for n, t in enumerate(templates)))
    starts = F.sequence(F.lit(0), F.size("words") - k)
    placed = spark.range(1).select(F.inline(listed)).select("template", "words", F.explode(starts).alias("at"))
    names = [f"g{j}" for j in range(k)]
    placed = placed.select("template", "at", *(F.get("words", F.col("at") + j).alias(g) for j, g in enumerate(names)))
    return placed.withColumn("gram", F.xxhash64(*names))


def _of_template(values: list, kind: str) -> Column:
    """The value of the template that a row names."""
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("template"))


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, slack: int = SLACK) -> DataFrame:
    """(doc_id, tie, n_words, copies, label, base, verified, first_word, end_word, share).

    A row is a span, in words from 0, end exclusive; every document also has one row
    without a label, so that none is missing. ``share`` is the part of the template's words
    that the span's votes cover; ``verified`` that it reaches what the template asks for. ``tie`` is a hash
    of the text and ``copies`` the number of equal (doc_id, text) rows, which share their spans.
    """
    row = ["doc_id", "tie", "n_words"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Cutting takes time in proportion to the text; only the first and last piece can be empty.
    words = F.array_remove(F.split(ascii_lower(F.col("text")), BETWEEN), "")
    cut = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), words.alias("words"))
    places = cut.select("doc_id", "tie", F.size("words").cast("long").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "word"))
    following = [F.get("words", F.col("pos") + j).alias(f"w{j}") for j in range(k)]
    names = [f"w{j}" for j in range(k)]
    grams = places.select(*row, "pos", *following).withColumn("hash", F.when(F.col("pos") + k <= F.col("n_words"), F.xxhash64(*names)))
    known = template_grams(docs.sparkSession, templates, k)
    # The last word begins no gram, so its row never meets a template and stands for the document.
    alone = F.col("pos").isNull() | (F.col("pos") == F.col("n_words") - 1)
    same = F.lit(True)
    for j in range(k):
        same = same & (F.col(f"w{j}") == F.col(f"g{j}"))
    # Joined on the hash alone, a single long; equal hashes of other words do not vote.
    votes = grams.join(known, F.col("hash") == F.col("gram"), "left").where(same | alone)
    # A place of a template votes once for a diagonal; the two give the word of the document.
    diagonal = F.when(F.col("template").isNotNull(), F.col("pos") - F.col("at"))
    cast = votes.groupBy(*row, "template", diagonal.alias("diagonal"), "at").agg(F.count("*").alias("rows"))
    base = _of_template([t.base for t in templates], "boolean")
    in_order = W.partitionBy(*row, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(in_order) > F.when(base, 0).otherwise(slack)
    merged = cast.withColumn("span", F.when(apart, 1).otherwise(0)).withColumn(
        "span", F.sum("span").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    )
    spread = merged.withColumn("covered", F.explode_outer(F.sequence(F.col("at"), F.col("at") + (k - 1))))
    word = F.col("diagonal") + F.col("at")
    spans = spread.groupBy(*row, "template", "span").agg(
        F.count_distinct("covered").alias("covered"), F.max("rows").alias("rows"),
        F.min(word).cast("long").alias("first_word"), (F.max(word) + k).cast("long").alias("end_word"),
    )
    none = F.col("template").isNull()
    share = F.col("covered") / _of_template([len(t.words) for t in templates], "double")
    return spans.select(
        *row, F.when(none, F.col("rows")).alias("copies"), _of_template([t.label for t in templates], "string").alias("label"), base.alias("base"),
        (share >= _of_template([t.share for t in templates], "double")).alias("verified"),
        "first_word", "end_word", share.alias("share"),
    )


def document_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, slack: int = SLACK) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    ``n_base`` counts the places of base templates, first_word and last_word are their least
    and greatest start (null without any), ``labels`` those of all verified spans, and ``score`` the
    greatest share of a template that the document holds, 0 without a vote.

    A null text counts as empty: no words, no labels, score 0. A very long text is one row of
    its table here too: its words are one array, each of its places a row of its own after that. Repeated
    rows, ids included, give a row each; ties do not matter, since nothing is chosen. A null
    doc_id is an id like others. An empty table gives no rows. Further columns are ignored,
    whatever their names.
    """
    found = license_spans(docs, templates, k, slack)
    place = F.col("base") & F.col("verified")

    def listed(which: Column) -> Column:
        names = sorted({t.label for t in templates})
        return F.array_join(F.array(*(F.when(F.bool_or(which & (F.col("label") == name)), name) for name in names)), ",")

    one = found.groupBy("doc_id", "tie", "n_words").agg(
        F.max("copies").alias("copies"), F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("first_word"))).alias("first_word"), F.max(F.when(place, F.col("first_word"))).alias("last_word"),
        listed(place).alias("base_labels"), listed(F.col("verified")).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    each = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
