"""Queries op7 and op8: language and main text of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .html_text import page_texts
from .language_id import page_languages
from .queries import query


@query("op7_language", "pages")
def _languages(rows, spark, sf_dir):
    return page_languages(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


@query("op8_html_text", "pages")
def _texts(rows, spark, sf_dir):
    return page_texts(rows).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
