"""Streaming forms of the reports: same columns, watermarks, keyed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import logs as L, times
from ..operators import gmv, joins, shares
from ..operators.changes import latest_state
from ..session import ROCKSDB_PROVIDER, shared_dir
from ..sources.sinks import KeyedTable, stream_table
from ..sources.streams import with_event_time

DELAY = "5 seconds"
# The local day of the default zone begins 16 hours into the UTC day.
DAY_OFFSET = "16 hours"
# A day's counts take logs up to this late; then their state goes.
LATE = "1 day"
# Comments and logs of an order meet by slots this wide.
SLOT_MS = 5 * times.MINUTE_MS


def prepare(spark, count_state: bool = True) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    # Progress reports then tell the rows of the state, at the price of a look-up per write.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", str(count_state).lower())


def run_to_end(
    rows: DataFrame, keys: list[str], mode: str = "update", shape=None, closing=None, count_state: bool = True
) -> DataFrame:
    """Process what is there, then give the table the stream has written.

    ``shape`` is applied to each batch before writing; it may sort or rank,
    which a stream itself cannot. ``closing`` is called when all input has been
    processed; it may add a last row to the source, which the stream, started
    again from its checkpoint, then takes too. Without ``count_state`` the rows in state are not counted.
    """
    spark = rows.sparkSession
    prepare(spark, count_state)
    # What a stream appends replaces nothing, so all rows stay and are not grouped on reading.
    table = KeyedTable(shared_dir(spark, "stream-table"), [] if mode == "append" else keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(shape(batch) if shape else batch, batch_id)

    checkpoint = shared_dir(spark, "stream-state")

    def drain() -> None:
        stream_table(rows, write, checkpoint, mode).trigger(availableNow=True).start().awaitTermination()

    drain()
    if closing:
        closing()
        drain()
    return table.read(spark)


def local_day():
    """Grouping key that lets Spark drop a day's state once the watermark has passed it."""
    return F.window("event_time", "1 day", "1 day", DAY_OFFSET).alias("w")


def timed_logs(logs: DataFrame, delay: str = DELAY) -> DataFrame:
    return with_event_time(L.dated(logs), times.event_time("ts"), delay)


def daily_page_views(logs: DataFrame, delay: str = DELAY) -> DataFrame:
    """Page views per local day; every update replaces the day's count."""
    return (
        timed_logs(logs, delay)
        .groupBy(local_day(), "log_date", "log_type")
        .agg(F.count("*").alias("pv"))
        .select("log_date", "log_type", "pv")
    )


def windowed_page_views(logs: DataFrame, width: str = "10 seconds", delay: str = DELAY) -> DataFrame:
    return (
        timed_logs(logs, delay)
        .groupBy(F.window("event_time", width).alias("w"), "log_date", "log_type")
        .agg(F.count("*").alias("pv"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "log_date",
            "log_type",
            "pv",
        )
    )


def counts_by_time(rows: DataFrame, time, width: str = "1 hour", delay: str = LATE) -> DataFrame:
    """Rows per window of an event time of the caller's, as timestamps; rows without one are not counted."""
    return (
        with_event_time(rows, time, delay)
        .groupBy(F.window("event_time", width).alias("w"))
        .agg(F.count("*").alias("records"))
        .select(F.col("w.start").alias("window_start"), "records")
    )


def page_views_by_arrival(logs: DataFrame, width: str = "30 seconds") -> DataFrame:
    """Page views per window of the time at which they are processed."""
    arrived = logs.filter(F.col("log_type").isNotNull()).withColumn("arrival", F.current_timestamp())
    return (
        arrived.groupBy(F.window("arrival", width).alias("w"), "log_type")
        .agg(F.count("*").alias("pv"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "log_type", "pv")
    )


def running_page_visits(logs: DataFrame, delay: str = LATE) -> DataFrame:
    """Visits so far per (date, page), updated with every trigger.

    The state of a date goes ``delay`` after its end; later logs are not counted.
    """
    return (
        L.page_types_only(timed_logs(logs, delay))
        .groupBy(local_day(), F.col("log_date").alias("ds"), F.col("log_type").alias("page_name"))
        .agg(F.count("*").alias("pv"))
        .drop("w")
    )


def search_word_counts(logs: DataFrame, delay: str = LATE) -> DataFrame:
    """Searches per date and word; state as in :func:`running_page_visits`."""
    return (
        L.search_keywords(timed_logs(logs, delay))
        .groupBy(local_day(), "log_date", "keyword")
        .agg(F.count("*").alias("search_count"))
        .drop("w")
    )


def session_summaries(logs: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Sessions by inactivity, closed once the watermark passes the gap.

    ``session_window`` merges events exactly one gap apart, as the batch form
    does. A log of nobody is no session, but its time moves the watermark: the
    test names the event time, so that Spark keeps it above the watermark. One such log a gap and
    a delay after all others closes every session.
    """
    somebody = F.col("user_id").isNotNull() & (F.col("user_id") != "unknown")
    return (
        timed_logs(logs, delay)
        .filter(somebody | F.col("event_time").isNull())
        .groupBy(F.session_window("event_time", gap).alias("w"), "user_id")
        .agg(
            F.count("*").alias("total_events"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
        )
        .select("user_id", "start_time", "end_time", "total_events")
    )


def device_users(logs: DataFrame, delay: str = LATE) -> DataFrame:
    """Device users per day and device: duplicates go first, then a count.

    The watermark bounds both states.
    """
    wanted = timed_logs(logs, delay).filter(
        F.col("userkey").isNotNull() & F.col("plat").isNotNull()
    )
    once = wanted.dropDuplicatesWithinWatermark(
        ["log_date", "plat", "brand", "platv", "userkey"]
    )
    counted = once.groupBy(local_day(), "log_date", "plat", "brand", "platv").agg(F.count("*").alias("users"))
    return counted.drop("w")


def sale_slices(sales: DataFrame, delay: str = DELAY) -> DataFrame:
    """Amount per (step, id, product): the state of the cumulative report.

    A step's state goes once the watermark has passed it.
    """
    rows = gmv.sales_rows(sales)
    timed = with_event_time(rows, times.event_time("event_ms"), delay)
    width = f"{gmv.STEP_MS // times.MINUTE_MS} minutes"
    return (
        timed.groupBy(F.window("event_time", width).alias("w"), "id", "product_id")
        .agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))
        .select(F.unix_millis("w.end").alias("step_end"), "id", "product_id", "amount")
    )


def cumulative_gmv(slices: DataFrame, n: int = 5) -> DataFrame:
    """The cumulative report from a table of slices, at any moment."""
    as_sales = slices.select(
        (F.col("step_end") - 1).alias("event_ms"), "id", "product_id", "amount"
    )
    return gmv.gmv_topn(as_sales, n)


def first_seen_devices(logs: DataFrame) -> DataFrame:
    """First known sighting of each device, kept up to date."""
    return shares.new_devices(L.dated(logs))


def interval_join(comments: DataFrame, logs: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Comments with near logs of their order, both sides streaming.

    The time bounds let Spark drop what can no longer match. State is kept by (order, time
    slot), not by order alone: a row is compared with the near rows of a busy order, and each pair meets in the
    log's slot only.
    """
    reached = joins.slots_near(F.col("ts"), joins.BEFORE_MS, joins.AFTER_MS, SLOT_MS)
    left = with_event_time(
        comments.filter(F.col("order_id").isNotNull() & F.col("ts").isNotNull()).withColumn("slot", F.explode(reached)),
        times.event_time("ts"),
        delay,
        "comment_time",
    )
    right = with_event_time(
        logs.filter(F.col("order_id").isNotNull() & F.col("ts").isNotNull()).select(
            F.col("order_id").alias("log_order"), joins.slot(F.col("ts"), SLOT_MS).alias("log_slot"), F.col("ts").alias("log_ts"), "log_id", "ip"
        ),
        times.event_time("log_ts"),
        delay,
        "log_time",
    )
    near = F.expr(
        f"log_time BETWEEN comment_time - INTERVAL {joins.BEFORE_MS // 1000} SECONDS "
        f"AND comment_time + INTERVAL {joins.AFTER_MS // 1000} SECONDS"
    )
    same = (F.col("order_id") == F.col("log_order")) & (F.col("slot") == F.col("log_slot"))
    return left.join(right, same & near).drop("slot", "log_slot")


def latest_rows(changes: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str):
    """Change feed to a keyed table: each batch brings its newest change per key."""
    table = KeyedTable(path, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest_state(batch, keys, order, deleted=F.lit(False))
        table.upsert(newest, batch_id)

    return table, stream_table(changes, write, checkpoint, "append")
