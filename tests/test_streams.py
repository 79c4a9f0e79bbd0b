"""Streams fed file by file must end where the batch form ends."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopwake.functions import logs as L
from shopwake.functions.times import DAY_MS
from shopwake.operators import joins, metrics
from shopwake.plans import jobs as plans
from shopwake.reports.tables import StreamTables
from shopwake.sources.sinks import LineTable
from shopwake.sources.streams import file_lines, stored_table, with_event_time
from shopwake.streaming import jobs, profile, timers
from shopwake.streaming.moderation import ModerationStream
from test_operators import LOG_SCHEMA, traffic, walk_pairs, walk_reports


def as_files(rows, columns, folder, files, schema):
    """Rows in time order, cut into files whose times follow that order."""
    folder.mkdir()
    frame = pd.DataFrame(sorted(rows, key=lambda r: r[1]), columns=columns)
    if "at_tag" in columns:
        frame["at_tag"] = frame["at_tag"].astype("int32")
    size = -(-len(frame) // files)
    for i in range(files):
        path = folder / f"part-{i:03d}.parquet"
        frame[i * size : (i + 1) * size].to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def names(schema):
    return [f.split()[0] for f in schema.split(", ")]


TAGGED = "user_id string, at_ts bigint, at_tag int, at_id string, log_type string, brand string, plat string, payload string"


@pytest.fixture
def few_rows_a_batch(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch"]
    held = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "10")
    yield
    for n, v in held.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


@pytest.mark.parametrize("files, block", [(1, 3), (3, 256)])
def test_stateful_join_in_batches_and_blocks(spark, tmp_path, few_rows_a_batch, files, block):
    """Several batches of a user in one trigger are merged, held rows fill blocks, results fill frames."""
    test_stateful_join_equals_a_walk(spark, tmp_path, files, block=block, frame=4)


@pytest.mark.parametrize("files", [1, 4])
def test_stateful_join_equals_a_walk(spark, tmp_path, files, **sizes):
    comments, logs = traffic(11, n=200)
    known = {"hot", "u0"}
    rows = [(u, ts, profile.COMMENT, str(c), None, None, None, f'{{"comment_id":{c}}}') for u, ts, c in comments]
    rows += [(r[0], r[1], profile.LOG, r[2], r[3], r[6], r[7], f'{{"log_id":"{r[2]}"}}') for r in logs]
    # the user rows come late: pairs wait for them and are then released
    rows += [(u, 5_000_000, profile.USER, u, None, None, None, f'{{"uname":"{u}"}}') for u in known]
    path = as_files(rows, names(TAGGED), tmp_path / "in", files, TAGGED)
    jobs.prepare(spark)
    stream = stored_table(spark, path, "*.parquet", T._parse_datatype_string(TAGGED), 1)
    joined = stream.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=profile.ProfileJoin(buffer=5, **sizes), outputStructType=profile.OUTPUT,
        outputMode="Append", timeMode="None",
    )
    told = jobs.run_to_end(joined, ["user_id", "at_ts", "at_tag", "at_id", "log_no"], mode="append")
    ours = sorted((r["user_id"], r["at_ts"], r["at_tag"], r["at_id"], r["device_count"], r["log_no"], r["log_type"]) for r in told.collect())
    want = walk_reports([p for p in walk_pairs(comments, logs, 5) if p[0] in known])
    assert ours == sorted((*p[:5], *p[6:]) for p in want)


@pytest.mark.parametrize("files, buckets, suppress", [(1, 1, True), (4, 1, True), (4, 7, False)])
def test_users_share_state(spark, tmp_path, few_rows_a_batch, files, buckets, suppress):
    """As the walk, with users of a bucket in batches, blocks and frames of a few rows, and many users with nothing but a row."""
    comments, logs = traffic(17, n=200)
    known = {"hot", "u0", "u1"}
    rows = [(u, ts, profile.COMMENT, str(c), None, None, None, f'{{"comment_id":{c}}}') for u, ts, c in comments]
    rows += [(r[0], r[1], profile.LOG, r[2], r[3], r[6], r[7], f'{{"log_id":"{r[2]}"}}') for r in logs]
    rows += [(u, 5_000_000, profile.USER, u, None, None, None, f'{{"uname":"{u}"}}') for u in known]
    rows += [(f"idle{i}", i, profile.USER, f"idle{i}", None, None, None, '{"uname":"ä"}') for i in range(40)]
    path = as_files(rows, names(TAGGED), tmp_path / "in", files, TAGGED)
    stream = stored_table(spark, path, "*.parquet", T._parse_datatype_string(TAGGED), 1)
    jobs.prepare(spark)
    joined = profile.listed_pairs(profile.arrivals(stream, buckets, buffer=5, block=3, frame=4, suppress=suppress))
    told = jobs.run_to_end(joined, [], mode="append").collect()
    ours = sorted((r["user_id"], r["at_ts"], r["at_tag"], r["at_id"], r["device_count"], r["log_no"], r["log_type"]) for r in told)
    pairs = [p for p in walk_pairs(comments, logs, 5) if p[0] in known]
    assert ours == sorted((*p[:5], *p[6:]) for p in (walk_reports(pairs) if suppress else pairs))
    assert {r["user_info"] for r in told} <= {f'{{"uname":"{u}"}}' for u in known}


class Counted:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_state_calls_do_not_grow_with_the_users():
    join = profile.SharedProfileJoin(suppress=False)
    join.idle, join.known, join.held, join.batches = Counted(), Counted(), Cells(), Cells()
    columns = ["user_id", "at_ts", "at_tag", "at_id", "log_type", "brand", "plat", "payload"]
    for trigger in range(3):
        rows = [(f"u{i}", 0, profile.USER, f"u{i}", None, None, None, "{}") for i in range(500)] if trigger == 0 else []
        rows += [(f"u{i}", 10 * trigger + n, profile.LOG, f"l{n}", "view", "b", "p", '{"log_id":1}') for i in range(0, 500, 5) for n in range(4)]
        rows += [("u0", 10 * trigger + 9, profile.COMMENT, "1", None, None, None, "{}")]
        frame = pd.DataFrame(rows, columns=columns).astype({"brand": object, "log_type": object})
        (told,) = list(join.handleInputRows((0,), iter([frame]), None))
        assert len(told) == (1 if trigger == 0 else 5)
    assert join.idle.calls + join.known.calls <= 3 * 6
    assert not join.held and not join.batches


class Clock:
    """State handles and a clock without a stream, to fire the timer by hand."""

    def __init__(self, value):
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def getExpiryTimeInMs(self):
        return profile.DAY_MS

    def registerTimer(self, at):
        self.value = at


class Cells(dict):
    """Stands for a map state."""

    def updateValue(self, key, value):
        self[key] = value

    getValue, removeKey = dict.__getitem__, dict.pop


@pytest.mark.parametrize("frames", [0, 1, 2, 7])
def test_batches_of_a_trigger_are_merged(frames):
    join = profile.ProfileJoin(block=3)
    join.batches = Cells()
    rows = [[(7 * i) % 40, i % 3, str(i % 5), None, None, "ä", f'{{"n":{i}}}'] for i in range(60)]
    columns = ["at_ts", "at_tag", "at_id", "log_type", "brand", "plat", "payload"]
    parts = [pd.DataFrame(rows[i::frames], columns=columns).astype({"log_type": object, "brand": object}) for i in range(frames)]
    out = list(join._in_order(iter(parts)))
    assert sorted(map(str, out)) == sorted(map(str, rows if frames else []))
    assert [r[:3] for r in out] == sorted(r[:3] for r in out) and not join.batches


def test_daily_timer_repeats_the_newest_pair(spark):
    join = profile.ProfileJoin(daily=True)
    pair = (5, 1, "l", 1, "{}", "{}", "login", 3)
    join.newest, join.user, join.handle = Clock(pair), Clock(("{}",)), Clock(None)
    (out,) = join.handleExpiredTimer(("a",), None, Clock(None))
    assert out[["user_id", "at_ts", "log_no", "reason"]].values.tolist() == [["a", 5, 3, "daily"]]
    assert join.handle.value == 2 * profile.DAY_MS


def test_a_live_timer_repeats_the_newest_pair_twice(spark, tmp_path):
    rows = [("a", 1, profile.USER, "a", None, None, None, '{"uname":"a"}'), ("a", 2, profile.COMMENT, "1", None, None, None, '{"comment_id":1}'),
            ("a", 3, profile.LOG, "l", "login", "b", "p", '{"log_id":"l"}')]
    path = as_files(rows, names(TAGGED), tmp_path / "in", 1, TAGGED)
    stream = stored_table(spark, path, "*.parquet", T._parse_datatype_string(TAGGED))
    joined = stream.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=profile.ProfileJoin(daily=True, period_ms=2000), outputStructType=profile.OUTPUT,
        outputMode="Append", timeMode="ProcessingTime",
    )
    told = []
    timers.run_live(joined, lambda batch, n: told.extend((r["at_id"], r["reason"]) for r in batch.collect()), 2000, until=lambda: len(told) >= 3, most_seconds=120)
    assert told[:3] == [("l", "pair"), ("l", "daily"), ("l", "daily")]


LOGS = LOG_SCHEMA + ", opa string, keywords array<string>"


def log_stream(spark, tmp_path, files):
    _, logs = traffic(13, n=300)
    rows = [(*r[:1], 1_704_067_200_000 + r[1] * 20, *r[2:], "x", ["w1", " w2 "]) for r in logs]
    path = as_files(rows, names(LOGS.replace("array<string>", "list")), tmp_path / "logs", files, LOGS)
    schema = T._parse_datatype_string(LOGS)
    return stored_table(spark, path, "*.parquet", schema, 1), spark.read.schema(schema).parquet(path)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def test_counts_by_file_equal_batch(spark, tmp_path):
    stream, batch = log_stream(spark, tmp_path, 3)
    dated = L.dated(batch)
    assert same(jobs.run_to_end(jobs.daily_page_views(stream), ["log_date", "log_type"]), metrics.daily_page_views(dated))
    assert same(jobs.run_to_end(jobs.running_page_visits(stream), ["ds", "page_name"]), metrics.page_visit_totals(dated))
    assert same(
        jobs.run_to_end(jobs.windowed_page_views(stream), ["window_start", "log_date", "log_type"]),
        metrics.windowed_page_views(dated),
    )


def test_state_of_past_days_goes(spark, tmp_path):
    day = 1_704_067_200_000
    rows = [("u", day + d * DAY_MS + i, f"{d}-{i}", "search", *[None] * 8, "x", [f"w{i}"]) for d in (0, 1, 5, 10) for i in range(30)]
    folder = as_files(rows, names(LOGS), tmp_path / "logs", 4, LOGS)
    schema = T._parse_datatype_string(LOGS)
    stream = stored_table(spark, folder, "*.parquet", schema, 1)
    jobs.prepare(spark)
    query = jobs.search_word_counts(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) >= 60 and kept[-1] == 30
    counts = jobs.run_to_end(jobs.search_word_counts(stream), ["log_date", "keyword"])
    assert same(counts, metrics.search_word_counts(L.dated(spark.read.schema(schema).parquet(folder))))


def test_moderation_carries_histories_and_repeats(spark, tmp_path):
    texts = ["bad word", "花了5000", "fine", "花了9000 bad", "word 20元", "bad"]
    rows = [(i, f"o{i % 3}", ["a", "b", None][i % 3], "p", None, "20240101", 1000 + i // 2, texts[i * 7 % 6]) for i in range(40)]
    rows.append((99, "o", "a", "p", None, "20240101", None, "bad before all"))
    schema = "comment_id bigint, order_id string, user_id string, product_id string, total_amount string, ds string, ts bigint, comment string"
    comments = spark.createDataFrame(rows, schema)
    lexicon = spark.createDataFrame([("bad", "P0"), ("word", "P1")], "word string, level string")
    sink = LineTable(str(tmp_path / "lines"))
    stream = ModerationStream(spark, lexicon, None, sink, str(tmp_path / "state"), most_batches=2)
    cuts = ["ts is null or ts < 1003", "false", "ts between 1003 and 1011", "ts >= 1012"]
    for n, where in enumerate(cuts):
        for _ in range(1 + n % 2):  # every other trigger comes twice
            stream.write(comments.filter(where), n)
    columns = "comment_id bigint, sensitive_count bigint, recent_max double, recent_mean double, consumption_level string, result string"
    want = plans.moderate(comments, lexicon).select(*names(columns))
    got = L.parse_json(sink.read(spark), columns)
    assert same(got.drop("recent_max", "recent_mean"), want.drop("recent_max", "recent_mean"))
    assert got.count() == want.count() == 41 and stream.past.merged(spark) == 1


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, folder, rows):
    folder.mkdir()
    spark.createDataFrame(rows, EVENTS).write.parquet(str(folder / "events.parquet"))
    return StreamTables(spark, str(folder), 3)


def test_arrivals_are_whole_and_in_order(spark, tmp_path):
    day = pd.Timestamp("2024-01-01")
    rows = [(i, None if i % 10 == 0 else (day + pd.Timedelta(minutes=i % 3)).to_pydatetime(), 1, "view", 1.0, "{}") for i in range(60)]
    for name, given in (("some", rows), ("none", []), ("timeless", [(1, None, 1, "view", 1.0, "{}")])):
        arriving = events(spark, tmp_path / name, given)
        taken = jobs.run_to_end(arriving.stored("events").select("event_id"), ["event_id"], mode="append")
        assert sorted(r[0] for r in taken.collect()) == [r[0] for r in given]


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_is_a_file_or_a_folder_of_parts(spark, tmp_path, parts):
    frame = pd.DataFrame({"doc_id": range(30), "text": "a"})
    if parts:
        spark.createDataFrame(frame).repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        frame.to_parquet(tmp_path / "documents.parquet")
    arriving = StreamTables(spark, str(tmp_path)).stored("documents")
    taken = jobs.run_to_end(arriving.select("doc_id"), ["doc_id"], mode="append")
    assert sorted(r[0] for r in taken.collect()) == list(range(30))


def test_appended_rows_replace_nothing(spark, tmp_path):
    folder = as_files([("a", 1), ("a", 1), (None, 2), (None, 3), ("b", 4)], ["id", "ts"], tmp_path / "in", 2, "id string, ts bigint")
    rows = stored_table(spark, folder, "*.parquet", T._parse_datatype_string("id string, ts bigint"), 1)
    assert jobs.run_to_end(rows, ["id"], mode="append").count() == 5


def test_interval_join_meets_near_rows_of_a_busy_order(spark, tmp_path):
    start = 1_704_067_200_000
    at = [start + i * 100_000 + j for i in range(30) for j in (-1, 0, 1)]
    sides = {
        "comments": ("comment_id bigint, ts bigint, order_id string", [(i, ts, "busy") for i, ts in enumerate(at)] + [(900, None, "busy"), (901, start, None)]),
        "logs": ("log_id string, ts bigint, order_id string, ip string", [(f"l{i}", ts, "busy", "1") for i, ts in enumerate(at)] + [("x", start, "other", "2"), ("y", None, "busy", None)]),
    }
    streams, batches = [], []
    for name, (schema, rows) in sides.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(stored_table(spark, str(tmp_path / name), "*.parquet", T._parse_datatype_string(schema)))
        batches.append(spark.createDataFrame(rows, schema))
    shown = ["comment_id", "ts", "log_id", "log_ts", "ip"]
    joined = jobs.interval_join(*streams)
    # By the order alone, each row is compared with all rows of its order.
    (meeting,) = [line for line in joined._jdf.queryExecution().analyzed().toString().splitlines() if "Join Inner" in line]
    assert "order_id" in meeting and "slot" in meeting
    told = jobs.run_to_end(joined.select(shown), ["comment_id", "log_id"], mode="append", count_state=False)
    assert same(told, joins.interval_join(*batches).select(shown)) and told.count() > 1000


def test_every_session_is_closed_at_the_end(spark, tmp_path):
    day = pd.Timestamp("2024-01-01")
    minutes = [(1, 0), (1, 30), (1, 61), (2, 500), (1, 500), (2, 510), (3, 505)]
    rows = [(1000 + i, (day + pd.Timedelta(minutes=m)).to_pydatetime(), u, "view", 1.0, '{"k": 1}') for i, (u, m) in enumerate(minutes)]
    arriving = events(spark, tmp_path / "in", rows)
    found = jobs.run_to_end(jobs.session_summaries(arriving.logs), ["user_id", "start_time"], mode="append", closing=lambda: arriving.end(DAY_MS))
    assert sorted((r["user_id"], r["total_events"]) for r in found.collect()) == [("1", 1), ("1", 1), ("1", 2), ("2", 2), ("3", 1)]


def test_top_words_inside_each_batch(spark, tmp_path):
    """Ranking is not for streams: the updated counts are ranked on reading."""
    stream, batch = log_stream(spark, tmp_path, 2)
    counts = jobs.run_to_end(jobs.search_word_counts(stream), ["log_date", "keyword"])
    assert same(counts, metrics.search_word_counts(L.dated(batch)))


def test_latest_rows_from_a_change_stream(spark, tmp_path):
    rows = [("a", 1, "r", 1), ("b", 1, "r", 1), ("a", 2, "u", 2), ("b", 3, "d", None)]
    schema = "id string, ts_ms bigint, op string, v double"
    path = as_files(rows, names(schema), tmp_path / "feed", 2, schema)
    stream = stored_table(spark, path, "*.parquet", T._parse_datatype_string(schema), 1)
    table, writer = jobs.latest_rows(stream, ["id"], ["ts_ms"], str(tmp_path / "t"), str(tmp_path / "c"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert {(r["id"], r["op"], r["v"]) for r in table.read(spark).collect()} == {("a", "u", 2.0), ("b", "d", None)}


def test_text_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"log_id":"x","ts":1704067200,"log_type":"login"}\n{oops\n')
    lines = file_lines(spark, str(tmp_path / "in"), streaming=True)
    parsed = with_event_time(L.dated(L.parse_logs(lines)), F.timestamp_millis("ts"))
    done = jobs.run_to_end(parsed.select("log_id", "log_date"), ["log_id"], mode="append")
    assert [tuple(r) for r in done.collect()] == [("x", "2024-01-01")]
