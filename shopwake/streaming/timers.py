"""Keyed state with processing-time timers, and live queries that let them fire.

Such a query never drains, so it runs under an interval trigger until nothing is due any more.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ROCKSDB_PROVIDER, shared_dir
from ..sources.sinks import KeyedTable, stream_table

WAIT_MS = 2000
SHARES = 16  # shares of a date's words, each a key of its own
TOP = 10


class TopAfterQuiet(StatefulProcessor):
    """The most frequent words of a (date, share), told once, when nothing has come for ``wait_ms``.

    Every arrival puts the timer off. What comes after the words were told
    changes nothing. State is one count per word, and one mark per key once it is told.
    """

    OUTPUT = "log_date string, share int, keyword string, cnt bigint"

    def __init__(self, wait_ms: int = WAIT_MS, top: int = TOP):
        self.wait_ms, self.top = wait_ms, top

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "keyword string", "cnt bigint")
        self.due = handle.getValueState("due", "at bigint")
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.told.exists():
            for frame in rows:
                for word, n in frame.groupby("keyword")["n"].sum().items():
                    before = self.counts.getValue((word,))[0] if self.counts.containsKey((word,)) else 0
                    self.counts.updateValue((word,), (before + int(n),))
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.due.update((at,))
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        words = sorted(((-cnt, word) for (word,), (cnt,) in self.counts.iterator()))[: self.top]
        self.counts.clear()
        self.due.clear()
        self.told.update((True,))
        yield pd.DataFrame([(key[0], key[1], word, -cnt) for cnt, word in words], columns=["log_date", "share", "keyword", "cnt"])

    def close(self) -> None:
        pass


def top_words_after_quiet(words: DataFrame, wait_ms: int = WAIT_MS, top: int = TOP) -> DataFrame:
    """Stream of (log_date, keyword) to the first ``top`` words of each share of a
    date's words, told once per share. A word is in one share, so the date's first words
    are among them: ``ranked_words`` finds these."""
    share = F.pmod(F.xxhash64("keyword"), F.lit(SHARES)).cast("int")
    return (
        words.select("log_date", share.alias("share"), "keyword", F.lit(1).alias("n"))
        .groupBy("log_date", "share")
        .transformWithStateInPandas(
            statefulProcessor=TopAfterQuiet(wait_ms, top), outputStructType=TopAfterQuiet.OUTPUT,
            outputMode="Append", timeMode="ProcessingTime",
        )
    )


def ranked_words(told: DataFrame, top: int = TOP) -> DataFrame:
    order = W.partitionBy("log_date").orderBy(F.col("cnt").desc(), "keyword")
    return told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        F.col("log_date").alias("date"), "rank", "keyword", F.col("cnt").alias("search_count")
    )


def _moment(progress) -> float:
    return datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp()


def run_live(
    rows: DataFrame, write: Callable[[DataFrame, int], None], wait_ms: int,
    interval: str = "1 second", until: Callable[[], bool] | None = None, most_seconds: float = 300,
) -> None:
    """Run a stream with timers under an interval trigger.

    It is stopped once ``until`` holds; without it, once two triggers that began
    ``wait_ms`` or more after the last trigger with input are done, by which time every timer of
    that length has fired; a source without rows ends after two. ``most_seconds`` without an end is an error.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    query = stream_table(rows, write, shared_dir(spark, "stream-state"), "append").trigger(processingTime=interval).start()
    last, quiet, seen, begun = None, 0, -1, time.time()
    try:
        while until() is False if until else quiet < 2:
            if query.awaitTermination(0.2):
                break
            if time.time() - begun > most_seconds:
                raise TimeoutError(f"the stream did not come to rest in {most_seconds} seconds")
            for p in query.recentProgress:
                if p["batchId"] <= seen:
                    continue
                seen = p["batchId"]
                if p["numInputRows"]:
                    last, quiet = _moment(p), 0
                elif last is None or _moment(p) > last + wait_ms / 1000:
                    quiet += 1
    finally:
        query.stop()


def live_table(rows: DataFrame, keys: list[str], wait_ms: int, interval: str = "1 second") -> DataFrame:
    """The table that a stream with timers has written when it comes to rest."""
    spark = rows.sparkSession
    table = KeyedTable(shared_dir(spark, "stream-table"), keys)
    run_live(rows, table.upsert, wait_ms, interval)
    return table.read(spark)
