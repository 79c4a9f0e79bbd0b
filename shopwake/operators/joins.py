"""Joins of comments, logs and users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import times
from ..sources.staging import staged
from .ordered import ordered_scan, segments
from .shares import device_sets, user_devices

# No join here carries a broadcast hint: Spark broadcasts a side whose size it
# has checked against its threshold and splits skewed keys otherwise.

BEFORE_MS, AFTER_MS = 10 * times.MINUTE_MS, 5 * times.MINUTE_MS
LOG_BUFFER = 50

# Attributes of a user the dimension does not hold.
DEFAULT_USER = {"user_name": "unknown", "age": 0, "user_level": "UNKNOWN"}


def with_user_defaults(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Dimension lookup; unknown users get the default attributes."""
    joined = rows.join(users.select("user_id", *DEFAULT_USER), "user_id", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_USER.items()}
    )


def slot(ts: Column, width_ms: int) -> Column:
    """The number of the time slot a moment lies in."""
    return F.floor(ts / width_ms)


def slots_near(ts: Column, before_ms: int, after_ms: int, width_ms: int) -> Column:
    """All slots with moments from ``before_ms`` before to ``after_ms`` after one."""
    return F.sequence(slot(ts - before_ms, width_ms), slot(ts + after_ms, width_ms))


def interval_join(
    comments: DataFrame,
    logs: DataFrame,
    before_ms: int = BEFORE_MS,
    after_ms: int = AFTER_MS,
) -> DataFrame:
    """Comments with the address of each log of their order near in time.

    The join key is (order, time bucket), not the order alone: one busy order
    is spread over its time span.
    """
    width = before_ms + after_ms
    ts = F.col("ts")
    left = comments.filter(F.col("order_id").isNotNull() & ts.isNotNull()).withColumn(
        "_bucket", F.explode(slots_near(ts, before_ms, after_ms, width))
    )
    right = logs.filter(F.col("order_id").isNotNull() & ts.isNotNull()).select(
        F.col("order_id").alias("_order"),
        slot(ts, width).alias("_at"),
        F.col("ts").alias("log_ts"),
        "log_id",
        "ip",
    )
    near = F.col("log_ts").between(ts - before_ms, ts + after_ms)
    return left.join(
        right,
        (F.col("order_id") == F.col("_order")) & (F.col("_bucket") == F.col("_at")) & near,
    ).drop("_bucket", "_order", "_at")


# --- comments and logs of a user, in order of arrival -----------------------
#
# Arrival order is (ts, comment before log, id). A log meets the comment that
# is current when it arrives; a comment meets logs that came before it.

AT = ["at_ts", "at_tag", "at_id"]


def timeline(comments: DataFrame, logs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Both inputs of each user on one line.

    ``comments``: user_id, ts, comment_id and small columns (all are carried
    along with later logs, so leave long texts out). ``logs``: user_id, ts,
    log_id, brand, plat and others, of which those ``carried`` travel with
    the line (all but the user if not given). Adds per row ``current`` (newest comment
    so far), ``log_no`` (logs so far) and ``device_count`` (devices so far).
    """
    comments = comments.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    logs = logs.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    comment = F.struct(*[c for c in comments.columns if c != "user_id"])
    log = F.struct(*(carried or [c for c in logs.columns if c != "user_id"]))

    first_seen = user_devices(logs).select(
        "user_id", F.col("log_id").alias("_first"), F.lit(1).alias("new_device")
    )
    marked = logs.join(
        first_seen.withColumnRenamed("user_id", "_user"),
        (F.col("user_id") == F.col("_user")) & (F.col("log_id") == F.col("_first")),
        "left",
    )
    left = comments.select(
        "user_id",
        F.col("ts").alias("at_ts"),
        F.lit(0).alias("at_tag"),
        F.col("comment_id").cast("string").alias("at_id"),
        comment.alias("comment"),
        F.lit(0).alias("new_device"),
    )
    right = marked.select(
        "user_id",
        F.col("ts").alias("at_ts"),
        F.lit(1).alias("at_tag"),
        F.col("log_id").cast("string").alias("at_id"),
        log.alias("log"),
        F.coalesce("new_device", F.lit(0)).alias("new_device"),
    )
    line = left.unionByName(right, allowMissingColumns=True)
    return ordered_scan(
        line,
        ["user_id"],
        AT,
        sums={
            "log_no": F.col("at_tag").cast("bigint"),
            "device_count": F.col("new_device").cast("bigint"),
        },
        latest={"current": F.col("comment")},
    ).drop("new_device")


def coverage(line: DataFrame) -> DataFrame:
    """Which pairs exist when a comment meets all earlier logs of its user.

    Writing those pairs out grows with the square of a user's rows, so they
    are given as ranges: a comment meets the logs numbered 1 to
    ``earlier_logs``, a log meets the comment ``current_comment``.
    """
    is_log = F.col("at_tag") == 1
    return line.select(
        "user_id",
        *AT,
        F.when(is_log, F.col("log_no")).alias("log_no"),
        F.when(is_log, F.col("current.comment_id")).alias("current_comment"),
        F.when(~is_log, F.col("log_no")).alias("earlier_logs"),
    )


def comment_log_pairs(line: DataFrame, buffer: int = LOG_BUFFER) -> DataFrame:
    """Pairs of the newest comment with each log, and of each comment with the
    ``buffer`` logs before it.

    ``line`` is a staged :func:`timeline`; it is read for logs and for
    comments. Logs are joined by (user, block of ``buffer`` logs): a comment
    needs at most two blocks and a block never holds more than ``buffer``
    rows, however busy the user is.
    """
    on_arrival = line.filter((F.col("at_tag") == 1) & F.col("current").isNotNull()).select(
        "user_id",
        *AT,
        "device_count",
        F.col("current").alias("comment"),
        "log",
        F.col("log_no"),
    )
    last, first = F.col("log_no"), F.greatest(F.col("log_no") - buffer + 1, F.lit(1))

    def block(n):
        return F.floor((n - 1) / buffer)

    waiting = (
        line.filter((F.col("at_tag") == 0) & (F.col("log_no") > 0))
        .select(
            "user_id",
            *AT,
            "device_count",
            "comment",
            first.alias("_first"),
            last.alias("_last"),
            F.explode(F.array_distinct(F.array(block(first), block(last)))).alias("_block"),
        )
    )
    stored = line.filter(F.col("at_tag") == 1).select(
        F.col("user_id").alias("_user"),
        block(F.col("log_no")).alias("_at"),
        "log",
        "log_no",
    )
    met = waiting.join(
        stored,
        (F.col("user_id") == F.col("_user"))
        & (F.col("_block") == F.col("_at"))
        & F.col("log_no").between(F.col("_first"), F.col("_last")),
    )
    return on_arrival.unionByName(met.select(*on_arrival.columns))


def with_device_list(pairs: DataFrame, logs: DataFrame) -> DataFrame:
    """Add the devices a user had shown when the pair was made."""
    lists = device_sets(logs.filter(F.col("user_id").isNotNull()))
    joined = pairs.join(lists, "user_id", "left")
    known = F.slice("devices", F.lit(1), F.col("device_count").cast("int"))
    return joined.withColumn("devices", known)


def with_user_info(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """Pairs of users with a profile row, joined to its latest version.

    ``users`` has one row per user; its columns come back as ``user_info``.
    """
    info = users.select(
        F.col("user_id").alias("_user"), F.struct(*users.columns).alias("user_info")
    )
    return pairs.join(info, F.col("user_id") == F.col("_user")).drop("_user")


# Log types that are always reported, and the longest silence.
IMPORTANT_TYPES = ("payment", "login", "purchase", "checkout", "order", "search")
SILENCE_MS = 60 * times.SECOND_MS
EMISSION = [*AT, "log_no"]


def _later_emissions(batches):
    """Sorted rows of runs to those more than the silence after the last one."""
    run, last = None, None
    for rows in batches:
        keep = []
        for name, anchor, ts in zip(rows["run"], rows["anchor"], rows["at_ts"]):
            if name != run:
                run, last = name, anchor
            chosen = ts - last > SILENCE_MS
            if chosen:
                last = ts
            keep.append(chosen)
        yield rows[keep]


def _late_reports(cut: DataFrame) -> DataFrame:
    """(user, emission) of the rows inside runs that the silence alone reports.

    ``cut`` has ``_run`` and ``_step`` of :func:`segments`. Only rows more than a
    minute after their run's start can be such; they are walked run by run.
    """
    anchor = F.col("_run.at_ts")
    late = cut.filter((F.col("_step") > 1) & (F.col("at_ts") - anchor > SILENCE_MS))
    run = F.concat_ws("|", "user_id", *[F.col(f"_run.{c}") for c in EMISSION])
    # Of several rows at one instant only the first can be reported.
    instants = late.groupBy(run.alias("run"), anchor.alias("anchor"), "user_id", "at_ts").agg(
        F.min(F.struct(*EMISSION)).alias("_row")
    )
    walked = (
        instants.select("run", "anchor", "user_id", "at_ts", "_row.at_tag", "_row.at_id", "_row.log_no")
        .repartition("run")
        .sortWithinPartitions("run", "at_ts")
    )
    return walked.mapInPandas(_later_emissions, walked.schema).select("user_id", *EMISSION)


def significant(pairs: DataFrame) -> DataFrame:
    """Drop pairs that bring nothing new.

    A pair is reported if it is the user's first, its type is important, its
    type or the device set differs from the last report, or the last report is
    more than a minute old. The device set only grows and an unreported pair
    has the type of the last report, so all conditions but the minute compare
    with the row before and cut the user into runs that start with a report.
    Inside a run only rows more than a minute after its start can be reported;
    those few are walked in order, run by run. Where the pairs are still to be
    made, :func:`reports` decides on the arrivals instead.
    """
    shown = pairs.withColumns(
        {"_type": F.lower(F.col("log.log_type")), "_ms": F.col("at_ts")}
    )
    cut = segments(
        shown,
        ["user_id"],
        EMISSION,
        ["_type", "device_count", "_ms"],
        lambda before, now: now["_type"].isin(*IMPORTANT_TYPES)
        | ~now["_type"].eqNullSafe(before["_type"])
        | (now["device_count"] != before["device_count"])
        | (now["_ms"] - before["_ms"] > SILENCE_MS),
        start="_run",
        step="_step",
    )
    chosen = _late_reports(cut)
    reported = cut.filter(F.col("_step") == 1).unionByName(
        cut.join(chosen, ["user_id", *EMISSION], "left_semi").select(*cut.columns)
    )
    return reported.drop("_type", "_ms", "_run", "_step")


# --- reported pairs, decided before they are made ----------------------------
#
# The pairs of one comment follow each other, and so do the numbers of their
# logs. So a comment's pairs but its first are told by their logs alone: the type is important
# or another than that of the log before. Only a comment's first pair and the pair of
# each log need the report before them; the row before is always of the newest log then.

ARRIVALS_PER_TASK = 2_000


def of_commenters(comments: DataFrame, logs: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments and logs of the users with a profile row and a comment: no others have pairs to tell."""
    seen = comments.filter(F.col("ts").isNotNull()).select("user_id").distinct()
    both = staged(seen.join(users.select("user_id"), "user_id", "left_semi"), "commenters")
    return comments.join(both, "user_id", "left_semi"), staged(logs.join(both, "user_id", "left_semi"), "logs")


def _block(number, buffer: int):
    return F.floor((number - 1) / buffer)


def _near_logs(line: DataFrame, buffer: int, *fields: str) -> DataFrame:
    """Per user and block of ``buffer`` logs, ``_near``: the logs of the block and of the one
    before in order, with ``own``, whether a pair with it after the log before is told."""
    at = _block(F.col("log_no"), buffer)
    entry = F.struct("log_no", F.struct(*[f"log.{f}" for f in fields]).alias("log"))
    listed = (
        line.filter(F.col("at_tag") == 1)
        .select(F.col("user_id").alias("_user"), F.explode(F.array(at, at + 1)).alias("_near_at"), entry.alias("_entry"))
        .groupBy("_user", "_near_at")
        .agg(F.collect_list("_entry").alias("_near"))
        .withColumn("_near", F.array_sort("_near", lambda a, b: (a["log_no"] - b["log_no"]).cast("int")))
    )

    def told(x, i):
        now, before = F.lower(x["log"]["log_type"]), F.lower(F.get("_near", i - 1)["log"]["log_type"])
        own = F.coalesce(now.isin(*IMPORTANT_TYPES), F.lit(False)) | ~now.eqNullSafe(before)
        return F.struct(x["log_no"].alias("log_no"), x["log"].alias("log"), own.alias("own"))

    return listed.withColumn("_near", F.transform("_near", told))


def _met():
    """The logs of an arrival's pairs, from the number ``from_no`` to ``to_no``."""
    start = (F.col("from_no") - F.get("_near", F.lit(0))["log_no"] + 1).cast("int")
    return F.slice("_near", start, (F.col("to_no") - F.col("from_no") + 1).cast("int"))


def _told_arrivals(line: DataFrame, buffer: int) -> DataFrame:
    """Arrivals with a pair to tell: ``from_no`` and ``to_no`` number the logs it meets, ``head``
    says whether its first pair is told."""
    is_log, last = F.col("at_tag") == 1, F.col("log_no")
    arrived = ["user_id", *AT, "device_count", "comment_id", "from_no", "to_no"]
    seen = line.filter(F.when(is_log, F.col("current").isNotNull()).otherwise(last > 0)).select(
        "user_id", *AT, "device_count",
        F.col("current.comment_id").alias("comment_id"),
        F.when(is_log, last).otherwise(F.greatest(last - buffer + 1, F.lit(1))).alias("from_no"),
        last.alias("to_no"),
        F.lower("log.log_type").alias("_type"),
    )
    met = (
        seen.filter(~is_log)
        .join(
            _near_logs(line, buffer, "log_type"),
            (F.col("user_id") == F.col("_user")) & (_block(F.col("to_no"), buffer) == F.col("_near_at")),
        )
        .select(*arrived, _met().alias("_met"))
    )

    def kind(i: int):
        return F.lower(F.element_at("_met", i)["log"]["log_type"])

    comments = met.select(
        *arrived, kind(1).alias("_type"), kind(-1).alias("_after"),
        F.exists(F.slice("_met", 2, buffer), lambda x: x["own"]).alias("_more"),
    )
    logs = seen.filter(is_log).select(*arrived, "_type", F.col("_type").alias("_after"), F.lit(False).alias("_more"))
    heads = staged(comments.unionByName(logs), "heads")
    # A comment's told pairs after its first start a run, whatever is before.
    marks = heads.filter("_more").withColumns({"log_no": F.col("to_no"), "_mark": F.lit(True)})
    rows = heads.withColumns({"log_no": F.col("from_no"), "_mark": F.lit(False)}).unionByName(marks)
    cut = segments(
        rows.withColumn("_ms", F.col("at_ts")),
        ["user_id"],
        EMISSION,
        ["_type", "_after", "_mark", "device_count", "_ms"],
        lambda before, now: now["_mark"]
        | now["_type"].isin(*IMPORTANT_TYPES)
        | ~now["_type"].eqNullSafe(before["_after"])
        | (now["device_count"] != before["device_count"])
        | (now["_ms"] - before["_ms"] > SILENCE_MS),
        start="_run",
        step="_step",
    )
    cut = staged(cut.select(*arrived, "log_no", "_mark", "_more", "_run", "_step"), "runs")
    late = _late_reports(cut).withColumn("_late", F.lit(True))
    opened = (F.col("_step") == 1) | F.coalesce("_late", F.lit(False))
    told = cut.filter(~F.col("_mark")).join(late, ["user_id", *EMISSION], "left").withColumn("head", opened)
    return told.filter(F.col("head") | F.col("_more")).select(*arrived, "head")


def reports(line: DataFrame, buffer: int, *fields: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The arrivals that tell a pair, narrow, and what adds ``pairs`` to them: an array
    of (log_no, log) with the ``fields`` of each log told, at most ``buffer``.

    Together they are the pairs that :func:`significant` keeps of :func:`comment_log_pairs`. What belongs
    to a comment or a user joins the arrivals first, the logs come last: a comment
    has up to ``buffer`` pairs. ``line`` is a staged :func:`timeline`.
    """
    told = staged(_told_arrivals(line, buffer).withColumn("_at", _block(F.col("to_no"), buffer)), "told")
    parts = F.ceil(F.count("*") / ARRIVALS_PER_TASK).alias("_parts")
    # Many arrivals at the same logs go to several tasks, each with these logs.
    busy = staged(told.groupBy("user_id", "_at").agg(parts).filter("_parts > 1"), "busy")
    part = F.pmod(F.xxhash64(*AT), F.coalesce("_parts", F.lit(1)))
    arrivals = told.join(busy, ["user_id", "_at"], "left").withColumn("_part", part).drop("_parts")

    def with_pairs(rows: DataFrame) -> DataFrame:
        copies = busy.select(F.col("user_id").alias("_user"), F.col("_at").alias("_near_at"), "_parts")
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))
        near = _near_logs(line, buffer, *fields).join(copies, ["_user", "_near_at"], "left").withColumn("_near_part", each)
        same = [F.col(a) == F.col(b) for a, b in (("user_id", "_user"), ("_at", "_near_at"), ("_part", "_near_part"))]
        told_ones = F.filter("_met", lambda x, i: F.when(i == 0, F.col("head")).otherwise(x["own"]))
        listed = rows.join(near, same)
        if "arrived" in rows.columns:
            listed = listed.withColumn("_one", F.explode("arrived")).select(*[c for c in rows.columns if c != "arrived"], "_one.*", "_near")
        kept = [c for c in listed.columns if c in rows.columns or c in arrivals.columns]
        joined = listed.select(*kept, _met().alias("_met")).withColumn("pairs", told_ones)
        return joined.drop("_met", "_at", "_part", "from_no", "to_no", "head")

    return arrivals, with_pairs


def by_comment(arrivals: DataFrame) -> DataFrame:
    """The arrivals of :func:`reports` with one row for those of a comment at the same logs, listed as ``arrived``.

    What joins these rows travels once for all of them. A list has the arrivals of one block of logs and the comment's own.
    """
    same = ["user_id", "comment_id", "_at", "_part"]
    one = F.struct(*[c for c in arrivals.columns if c not in same])
    return arrivals.groupBy(*same).agg(F.collect_list(one).alias("arrived"))


def pair_rows(arrivals: DataFrame) -> DataFrame:
    """Each of the ``pairs`` of an arrival as a row with ``log_no`` and ``log``."""
    listed = arrivals.withColumn("_pair", F.explode("pairs"))
    return listed.withColumns({"log_no": F.col("_pair.log_no"), "log": F.col("_pair.log")}).drop("_pair", "pairs")


def recent(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key. The limit applies before the shuffle
    too, so a busy key sends ``n`` rows per task."""
    newest = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(newest.alias("_row")).select("_row.*")
