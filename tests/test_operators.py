"""Operators against brute force on small fixtures."""

import random
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopwake.functions import comments as M, profiles as P
from shopwake.operators import changes as C, geo, gmv, joins as J, lexicon as X
from shopwake.operators import metrics, moderation, ordered, sessions, shares, wide
from shopwake.plans import jobs as plans, profiles

LOG_SCHEMA = (
    "user_id string, ts bigint, log_id string, log_type string, order_id string, "
    "product_id string, brand string, plat string, platv string, softv string, device string, userkey string"
)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def random_events(n, users=4, span=7200_000, seed=1):
    """One user owns a third of all rows; many equal instants."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else f"u{rnd.randrange(users)}"
        rows.append((user, rnd.randrange(0, span, 500), f"{i:05d}", rnd.choice(["a", "b", None]), rnd.choice([None, 1.0, 2.0, 5.0])))
    return rows


def test_ordered_scan_equals_a_walk(spark):
    rows = random_events(600)
    df = spark.createDataFrame(rows, "k string, ts bigint, id string, kind string, v double")
    got = ordered.ordered_scan(
        df, ["k"], ["ts", "id"], previous=["kind", "ts"], sums={"n": F.lit(1)},
        latest={"known": F.col("v")}, slice_ms=600_000,
    )
    ours = {r["id"]: (r["prev_kind"], r["prev_ts"], r["n"], r["known"]) for r in rows_of(got)}
    by_key, want = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key[r[0]].append(r)
    for group in by_key.values():
        known = None
        for i, r in enumerate(group):
            known = known if r[4] is None else r[4]
            before = group[i - 1] if i else (None,) * 4
            want[r[2]] = (before[3], before[1], i + 1, known)
    assert ours == want


def test_segments_equal_a_walk(spark):
    rows = random_events(600, seed=2)
    df = spark.createDataFrame(rows, "k string, ts bigint, id string, kind string, v double")
    cut = ordered.segments(
        df, ["k"], ["ts", "id"], ["ts"], lambda b, n: n["ts"] - b["ts"] > 30_000, slice_ms=600_000
    )
    ours = {r["id"]: (r["segment_start"]["id"], r["segment_step"]) for r in rows_of(cut)}
    want, state = {}, {}
    for k, ts, i, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        last, start, step = state.get(k, (None, None, 0))
        if last is None or ts - last > 30_000:
            start, step = i, 0
        state[k] = (ts, start, step + 1)
        want[i] = (start, step + 1)
    assert ours == want


def visits(spark, times_ms):
    rows = [("u", t, f"{i:03d}", "page", "act") for i, t in enumerate(times_ms)]
    return spark.createDataFrame(rows, "user_id string, ts bigint, log_id string, page string, action string")


def test_session_gap_is_exclusive(spark):
    gap = sessions.GAP_MS
    cut = sessions.with_sessions(visits(spark, [0, gap, 2 * gap + 1]))
    assert [r["session_start"] for r in cut.orderBy("ts").collect()] == [0, 0, 2 * gap + 1]


def test_long_session_has_one_row(spark):
    cut = sessions.with_sessions(visits(spark, range(0, 12_000_000, 1000)))
    report = rows_of(sessions.session_report(cut))
    assert [(r["total_events"], r["total_duration"], r["avg_duration"], r["is_bounce"], r["unique_pages"]) for r in report] == [(12_000, 11_999_000, 1000, 0, 1)]
    steps = rows_of(sessions.session_steps(cut).orderBy("step"))
    assert [r["step"] for r in steps] == list(range(1, 12_001)) and {r["session_id"] for r in steps} == {report[0]["session_id"]}


def sales(spark, rows):
    return spark.createDataFrame(
        [(i, p, t, Decimal(a)) for i, p, t, a in rows], "id string, product_id string, event_ms bigint, amount decimal(18,2)"
    )


def brute_windows(rows, n, id_index):
    step, day = gmv.STEP_MS, gmv.SPAN_MS
    out = {}
    for d in {r[2] // day for r in rows}:
        mine = [r for r in rows if r[2] // day == d]
        end = min(r[2] for r in mine) // step * step + step
        while end <= (d + 1) * day:
            seen = [r for r in mine if r[2] < end]
            totals = defaultdict(Decimal)
            for r in seen:
                totals[r[id_index]] += Decimal(r[3])
            top = sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:n]
            out[(d * day, end)] = (sum((Decimal(r[3]) for r in seen), Decimal(0)), [x[0] for x in top])
            end += step
    return out


def check_gmv(spark, rows):
    df = sales(spark, rows)
    want = brute_windows(rows, 3, 0)
    totals = {(r["window_start"], r["window_end"]): r["gmv"] for r in rows_of(gmv.cumulative_totals(df))}
    assert totals == {k: v[0] for k, v in want.items()}
    lists = gmv.listed(gmv.cumulative_top(df, "id", n=3), "id", "ids")
    got = {(r["window_start"], r["window_end"]): r["ids"].split(",") for r in rows_of(lists)}
    assert got == {k: v[1] for k, v in want.items()}
    return totals


def random_sales(low, seed):
    rnd = random.Random(seed)
    day = gmv.SPAN_MS
    rows = [
        (f"i{rnd.randrange(12):02d}", f"p{rnd.randrange(5)}", rnd.randrange(0, 2 * day, 60_000), str(rnd.randrange(low, 50)))
        for _ in range(250)
    ]
    return [*rows, ("edge", "p0", 600_000, "1"), ("edge", "p0", 0, "0")]


def test_cumulative_windows_with_growing_sums(spark):
    totals = check_gmv(spark, random_sales(0, 3))
    for day in (0, gmv.SPAN_MS):
        line = [totals[k] for k in sorted(totals) if k[0] == day]
        assert line == sorted(line)


def test_cumulative_windows_with_refunds(spark):
    check_gmv(spark, random_sales(-40, 4))


def test_shares_sum_to_hundred(spark):
    rows = [(f"d{i}", "2024-01-01", ["iOS", "Android"][i % 2], f"b{i % 5}", f"m{i % 7}") for i in range(53)]
    df = spark.createDataFrame(rows, "device_id string, stat_date string, platform string, brand string, model string")
    for frame, keys in (
        (shares.platform_share(df), ["stat_date"]),
        (shares.brand_share(df), ["stat_date", "platform"]),
        (shares.model_share(df), ["stat_date", "platform", "brand"]),
    ):
        sums = frame.groupBy(*keys).agg(F.sum("percentage").alias("s")).collect()
        assert all(abs(float(r["s"]) - 100) <= 0.05 for r in sums)


def test_city_dictionary(spark):
    cities = spark.createDataFrame([("吉林", "吉林省"), ("吉林北", "吉林省"), ("海口", "海南省")], "city string, province string")
    rows = spark.createDataFrame([("中国|吉林北市",), ("海",), ("市",), ("xx",), (None,)], "region string")
    got = {r["region"]: (r["province"], r["city"]) for r in rows_of(geo.with_dictionary_city(rows, cities))}
    unknown = ("未知省", "未知市")
    assert got == {"中国|吉林北市": ("吉林省", "吉林北市"), "海": ("海南省", "海口市"), "市": unknown, "xx": unknown, None: unknown}


def test_ip_ranges_across_blocks(spark):
    ranges = spark.createDataFrame([(0, 70_000, "a"), (70_001, 70_001, "b")], "start_ip bigint, end_ip bigint, region string")
    rows = spark.createDataFrame([("0.1.17.112",), ("0.1.17.113",), ("0.1.17.114",), ("0.0.0.0",)], "ip string")
    got = {r["ip"]: r["region"] for r in rows_of(geo.with_region(rows, ranges))}
    assert got == {"0.1.17.112": "a", "0.1.17.113": "b", "0.1.17.114": None, "0.0.0.0": "a"}


def lexicon(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, level string")


def test_words_are_found_anywhere(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abc", k=rnd.randrange(2, 6))): rnd.choice(["P0", "P1", "P2"]) for _ in range(40)}
    words["毒"] = "P1"
    texts = [(i, "".join(rnd.choices("abcd 毒", k=n))) for i, n in enumerate([0, 1, 3, 50, 999, 1000, 1001, 2650])]
    df = spark.createDataFrame([*texts, (99, None)], "id int, comment string")
    order = sorted(words.items(), key=lambda w: X._order(*w))
    want = {i: [w for w in order if w[0] in t] for i, t in texts} | {99: []}
    large = lexicon(spark, words).union(spark.range(50_000).selectExpr("concat('a#', id)", "'P0'"))
    twice = lexicon(spark, words).union(lexicon(spark, words).withColumn("level", F.lit("P9")))
    for book in (lexicon(spark, words), large, twice):
        found = X.with_found(df, book, "id")
        assert {r["id"]: [tuple(w) for w in r["found"]] for r in rows_of(found)} == want
    empty = X.with_detection(df, lexicon(spark, words).limit(0), "id")
    assert {r["sensitive_level"] for r in rows_of(empty)} == {"CLEAN"}


def test_a_head_that_many_words_share(spark):
    """Each text holds the head many times and some of its 30,000 words, across the cuts of long texts."""
    rnd = random.Random(6)
    crowd = spark.range(30_000).selectExpr("concat('thé', id) AS word", "'P1' AS level").union(lexicon(spark, {"th": "P2", "x" * 450: "P0"}))
    texts = [(i, "".join(rnd.choice(["thé", "th", "é", " ", "😀", str(rnd.randrange(400)), "thé" + str(rnd.randrange(60_000))]) for _ in range(n))) for i, n in enumerate([1, 40, 300, 9_000])]
    texts.append((9, "a" * 9_800 + "x" * 450 + "b"))
    df = spark.createDataFrame(texts, "id int, comment string").repartition(4)

    def inside(text):
        after = {t[i:j] for t in text.split("thé")[1:] for i in (0,) for j in range(1, 6)}
        found = {f"thé{d}" for d in after if d.isascii() and d.isdigit() and str(int(d)) == d and int(d) < 30_000}
        return found | ({"th"} if "th" in text else set()) | ({"x" * 450} if "x" * 450 in text else set())

    got = {r["id"]: {w["word"] for w in r["found"]} for r in rows_of(X.with_found(df, crowd, "id"))}
    assert got == {i: inside(t) for i, t in texts}


def test_places_without_a_word_are_no_rows(spark):
    """The texts are tested where they lie: they are neither cut into rows nor shuffled."""
    df = spark.createDataFrame([(i, "x" * 5_000 + "bad" * (i % 2)) for i in range(40)], "id int, comment string")
    found = X.with_found(df, lexicon(spark, {"bad": "P0", "毒": "P1"}), "id").select("id", "found")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan and "Exchange hashpartitioning(id" in plan
    assert sum(len(r["found"]) for r in rows_of(found)) == 20
    begun = X._starts(np.arange(1 << X.BYTE_SLOT_BITS) == int(X._byte_slot(np.uint64(int.from_bytes(b"bad", "little")))), [3], 3)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "_text": ["xxbad", "", "bébad" + "y" * (X.SPAN + 9) + "bad"]}).slice(1)
    assert [r for b in begun(iter([batch])) for r in b.to_pylist()] == [{"id": 3, "rest": "bad"}] * 2


def test_moderation_stages_no_texts(spark, monkeypatch):
    """Only what was found is written and goes through the histories; the texts join once, at the end."""
    written = []
    monkeypatch.setattr(plans, "staged", lambda df, purpose: written.append(df.columns) or df)
    schema = "comment_id bigint, order_id string, user_id string, product_id string, total_amount string, ds string, ts bigint, comment string"
    df = spark.createDataFrame([(1, "o", "a", "p", "5", "20240101", 1, "a bad one"), (2, "o", "a", "p", None, "20240101", 2, " ")], schema)
    (row,) = rows_of(plans.moderate(df, lexicon(spark, {"bad": "P0"})))
    assert row["masked_comment"] == "a *** one" and row["order_id"] == "o" and row["sensitive_count"] == 1
    assert len(written) == 1 and not {"comment", "masked_comment"} & set(written[0])


def test_a_timeline_carries_what_is_asked(spark):
    comments, logs = traffic(3, n=30)
    c = spark.createDataFrame(comments, "user_id string, ts bigint, comment_id bigint")
    whole = J.timeline(c, spark.createDataFrame(logs, LOG_SCHEMA))
    narrow = J.timeline(c, spark.createDataFrame(logs, LOG_SCHEMA), carried=["log_id"])
    assert narrow.schema["log"].dataType.names == ["log_id"]
    shown = [*J.AT, "log_no", "device_count", "log.log_id"]
    assert sorted(map(str, narrow.select(shown).collect())) == sorted(map(str, whole.select(shown).collect()))


def test_masks_follow_the_word_order(spark):
    words = {"badness": "P1", "bad": "P0", "meh": "P2"}
    df = spark.createDataFrame([(1, "badness is bad, meh")], "id int, comment string")
    row = X.with_detection(df, lexicon(spark, words), "id").first()
    # P0 words are replaced first, so the longer P1 word no longer occurs.
    assert row["masked_comment"] == "***ness is ***, meh"
    assert row["sensitive_level"] == "P0" and row["is_sensitive"]
    full = X.with_found(df, lexicon(spark, words), "id").select(X.masked(F.col("comment"), F.col("found"), True)).first()
    assert full[0] == "***ness is ***, *"


def test_tokens_are_joined_only_without_a_direct_hit(spark):
    words = {"abcd": "P1", "狗东西": "P0", "xyz": "P2"}
    df = spark.createDataFrame([(1, "ab-cd"), (2, "狗 东,西"), (3, "XYZ"), (4, "xyz ab cd"), (5, "abc d e")], "id int, comment string")
    detected = X.with_detection(df, lexicon(spark, words), "id")
    got = {r["id"]: [w["word"] for w in r["found"]] for r in rows_of(detected)}
    assert got == {1: ["abcd"], 2: ["狗东西"], 3: ["xyz"], 4: ["xyz"], 5: ["abcd"]}


def test_word_lists(spark, tmp_path):
    (tmp_path / "p1.txt").write_text("# head\n foo \n\nbar\n", encoding="utf8")
    (tmp_path / "p0.txt").write_text("bar\n", encoding="utf8")
    book = X.combine(X.read_words(spark, str(tmp_path / "p1.txt"), "P1"), X.read_words(spark, str(tmp_path / "p0.txt"), "P0"))
    assert {tuple(r) for r in book.collect()} == {("foo", "P1"), ("bar", "P0")}


def test_consumption_bands(spark):
    def band(*amounts):
        rows = [("u", i * 10**7, f"{i}", a, False) for i, a in enumerate(amounts)]
        df = spark.createDataFrame(rows, "user_id string, ts bigint, id string, amount double, is_sensitive boolean")
        done = moderation.with_history(df, "id").orderBy("ts").collect()
        return [r["consumption_level"] for r in done]

    assert band(8000.0, None, 8001.0) == ["LOW", "LOW", "HIGH"]
    assert band(10000.0) == ["MEDIUM"] and band(10001.0) == ["HIGH"] and band(None) == ["LOW"]
    assert band(3000.0, 3000.0, 5000.0, 2999.0, 3000.0) == ["LOW", "MEDIUM", "HIGH", "MEDIUM", "LOW"]


def test_result_text(spark):
    df = spark.createDataFrame(
        [("o", "u", "p", "d", 5, 'say "x"\n', True, "P1", "bad", 12.5, "LOW"), (None, "u", "p", None, 5, "x", False, "CLEAN", None, None, None)],
        "order_id string, user_id string, product_id string, ds string, ts bigint, comment string, is_sensitive boolean, "
        "sensitive_level string, triggered_keyword string, amount double, consumption_level string",
    )
    first, second = [r[0] for r in df.select(M.result_json({"db": "d", "schema": "s", "table": "t"})).collect()]
    assert '"triggered_keyword":"bad","total_amount":12.50,"consumption_level":"LOW"}' in first
    assert '"user_comment":"say \\"x\\"\\n"' in first and '"blacklist_duration_days":60' in first
    assert "triggered_keyword" not in second and second.endswith('"total_amount":0,"consumption_level":"LOW"}')


def test_change_feed(spark):
    rows = [("r", 1, "a", 1), ("u", 1, "b", 2), ("r", 2, "c", 1), ("d", 2, None, 3), ("r", 3, "z", 1)]
    df = spark.createDataFrame(rows, "op string, id int, v string, ts_ms bigint")
    assert {(r["id"], r["v"]) for r in C.latest_state(df, ["id"], ["ts_ms"]).collect()} == {(1, "b"), (3, "z")}
    source = {"db": "d", "schema": "s", "table": "t"}
    plain = df.select("id", "v")
    feed = C.envelopes(plain, "u", source, F.lit(1)).unionByName(C.envelopes(plain, "d", source, F.lit(2), before=True))
    flat = C.flatten(feed)
    assert flat.count() == 5 and {r["table_name"] for r in flat.collect()} == {"d.s.t"}
    assert C.content_changes(feed).count() == 5


def test_wide_cells_round_trip(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, "x")], "k string, n int, s string")
    cells = wide.to_cells(df, "k")
    assert {tuple(r) for r in cells.collect()} == {("a", "info", "n", "1"), ("b", "info", "s", "x")}
    assert wide.scan(cells, 1).first()["cells"] == {"n": "1"}
    assert wide.row_count(cells).first()[0] == 2


def walk_pairs(comments, logs, buffer):
    """Arrival order by hand: (user, at, devices, comment, log no) per pair."""
    line = [(ts, 0, str(c), u, c) for u, ts, c in comments] + [(r[1], 1, r[2], r[0], r) for r in logs]
    state, out = defaultdict(lambda: {"c": None, "logs": [], "n": 0, "dev": set()}), []
    for ts, tag, i, user, item in sorted(line, key=lambda x: x[:3]):
        s = state[user]
        if tag == 0:
            s["c"] = item
            met = s["logs"][-buffer:]
        else:
            s["n"] += 1
            if item[6] is not None and item[7] is not None:
                s["dev"].add((item[6].lower(), item[7].lower()))
            s["logs"].append((s["n"], item[3]))
            met = s["logs"][-1:] if s["c"] is not None else []
        out += [(user, ts, tag, i, len(s["dev"]), s["c"], n, kind) for n, kind in met]
    return out


def walk_reports(pairs):
    last, out = {}, []
    for p in pairs:
        user, ts, _, _, devices, _, _, kind = p
        before = last.get(user)
        if (
            before is None or kind in J.IMPORTANT_TYPES or kind != before[2]
            or devices != before[1] or ts - before[0] > J.SILENCE_MS
        ):
            last[user] = (ts, devices, kind)
            out.append(p)
    return out


def traffic(seed, n=400):
    rnd = random.Random(seed)
    logs = []
    for i in range(n):
        user = "hot" if i % 3 else f"u{rnd.randrange(3)}"
        kind = rnd.choices(["page_view", "product_list", "login", "search"], [20, 2, 1, 1])[0]
        brand = rnd.choices(["Apple", "apple", "Mi", None], [30, 30, 1, 1])[0]
        logs.append((user, rnd.randrange(0, 9_000_000, 1000), f"l{i:04d}", kind, "o", "p", brand, "iOS", "v", "s", "d", "k"))
    comments = [(f"u{rnd.randrange(3)}" if i % 2 else "hot", rnd.randrange(0, 9_000_000, 1000), i) for i in range(25)]
    return comments, logs


def test_pairs_and_suppression_equal_a_walk(spark):
    comments, logs = traffic(7)
    line = J.timeline(
        spark.createDataFrame(comments, "user_id string, ts bigint, comment_id int"), spark.createDataFrame(logs, LOG_SCHEMA)
    ).cache()
    pairs = J.comment_log_pairs(line, buffer=5).cache()

    def shown(df):
        return sorted(
            (r["user_id"], r["at_ts"], r["at_tag"], r["at_id"], r["device_count"], r["comment"]["comment_id"], r["log_no"], r["log"]["log_type"])
            for r in df.collect()
        )

    walked = walk_pairs(comments, logs, 5)
    assert shown(pairs) == sorted(walked)
    reports = walk_reports(walked)
    assert len(reports) < len(walked)
    # some reports exist only because of the silent minute inside a run
    runs = [p for a, p in zip(walked, walked[1:]) if p in reports and a[0] == p[0] and a[7] == p[7] and p[1] - a[1] <= J.SILENCE_MS]
    assert runs
    assert shown(J.significant(pairs)) == sorted(reports)


@pytest.mark.parametrize("seed, buffer", [(7, 5), (8, 1), (9, 50)])
def test_reports_decided_per_arrival_equal_a_walk_over_all_pairs(spark, seed, buffer, monkeypatch):
    """Only told pairs are made, and one user's arrivals at the same logs go to several tasks."""
    monkeypatch.setattr(J, "ARRIVALS_PER_TASK", 3)
    comments, logs = traffic(seed)
    c = spark.createDataFrame(comments, "user_id string, ts bigint, comment_id int")
    users = spark.createDataFrame([("hot",), ("u1",), ("nobody",)], "user_id string")
    seen, known = J.of_commenters(c, spark.createDataFrame(logs, LOG_SCHEMA), users)
    line = J.timeline(seen, known, carried=["log_id", "log_type"]).cache()
    arrivals, with_pairs = J.reports(line, buffer, "log_id", "log_type")
    listed = with_pairs(arrivals)
    told = sorted(
        (r["user_id"], r["at_ts"], r["at_tag"], r["at_id"], r["device_count"], r["comment_id"], r["log_no"], r["log"]["log_type"])
        for r in J.pair_rows(listed).collect()
    )
    expected = [p for p in walk_reports(walk_pairs(comments, logs, buffer)) if p[0] in ("hot", "u1")]
    assert told == sorted(expected)
    assert all(0 < len(r["pairs"]) <= buffer for r in listed.select("pairs").collect())


def test_arrivals_of_a_comment_travel_as_one_row(spark):
    comments, logs = traffic(23)
    c = spark.createDataFrame(comments, "user_id string, ts bigint, comment_id int")
    line = J.timeline(c, spark.createDataFrame(logs, LOG_SCHEMA), carried=["log_id", "log_type"]).cache()
    arrivals, with_pairs = J.reports(line, 50, "log_id", "log_type")
    grouped = J.by_comment(arrivals).withColumn("text", F.lit("long"))
    assert grouped.count() < arrivals.count() / 3 and grouped.filter("size(arrived) > 51").isEmpty()
    shown = ["user_id", "at_ts", "at_tag", "at_id", "device_count", "comment_id", "pairs"]
    told = with_pairs(grouped)
    assert sorted(told.columns) == sorted([*shown, "text"])
    assert sorted(map(str, told.select(shown).collect())) == sorted(map(str, with_pairs(arrivals).select(shown).collect()))


def test_profile_json_put_together_of_pieces_equals_that_of_the_columns(spark):
    """Nulls are left out, also where a whole piece or nested form is null."""
    log = "struct<log_no: bigint, log: struct<kind: string, words: array<string>>>"
    rows = spark.createDataFrame(
        [("u", 1, 0, "c1", 'say "so", {ü}', [(1, ("a", ["x", ""])), (2, (None, None))]), ("v", 2, 0, "c2", None, [(3, (None, []))])],
        f"user_id string, at_ts bigint, at_tag int, at_id string, remark string, pairs array<{log}>",
    )
    pair = profiles.PerPair
    form = {
        "remark": F.col("remark"),
        "first": {"remark": F.col("remark"), "kind": pair(F.col("log.kind"))},
        "kind": pair(F.col("log.kind")),
        "both": pair(F.concat_ws("/", "said", "log.kind")),
        "second": {"deep": {"words": pair(F.col("log.words")), "user": F.col("user_id")}, "plain": {"remark": F.col("remark")}},
        "last": {"remark": F.col("remark")},
    }
    done = profiles._laid_out(rows, form, {"said": F.col("remark")})
    got = done.withColumn("expected", F.to_json(F.struct(*form))).collect()
    assert len(got) == 3 and [r["profile"] for r in got] == [r["expected"] for r in got]


def test_a_profile_works_out_once_what_belongs_to_a_log_or_a_comment(spark):
    """A pattern of an amount is matched once, lists and maps of a pair need no function of elements,
    and places whose two bytes begin no word are not looked at again."""
    texts = spark.createDataFrame([("花了99999999 价格 250.5 和 700",), ("7 元",), ("买了 120 块",), (None,)], "comment string")
    offered = texts.select(M.amount_in_text(F.col("comment")).alias("amount"))
    assert offered._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == len(M.AMOUNT_PATTERNS)
    assert [r[0] for r in offered.collect()] == [250.5, None, 120.0, None]

    ids = spark.createDataFrame([("b", "a"), ("a", "a"), (None, "a"), (None, None)], "x string, y string")
    both = ids.select(P.order_ids(F.col("x"), F.col("y")).alias("ids"))
    assert [r[0] for r in both.collect()] == [["b", "a"], ["a"], ["a"], []]
    assert "lambda" not in both._jdf.queryExecution().analyzed().toString()

    logs = spark.createDataFrame([("search", ["a", "b", "a"], 1704067200000), ("login", ["a"], 0), (None, None, None)], "log_type string, keywords array<string>, ts bigint")
    facts = logs.select(*[c.alias(n) for n, c in profiles.first_per_log().items()]).collect()
    assert [tuple(r) for r in facts] == [("2024-01-01 08:00:00", {"a": 2, "b": 1}), ("1970-01-01 08:00:00", {}), (None, {})]

    heads = next(X._begins(iter([pa.RecordBatch.from_pydict({"head": ["bad", "x"]})])))
    known = np.zeros((1 << X.BYTE_SLOT_BITS) + (1 << 16), bool)
    known[heads.column("slot").to_numpy()] = True
    first, every = known[1 << X.BYTE_SLOT_BITS :], np.ones(1 << X.BYTE_SLOT_BITS, bool)
    assert first.sum() == 257
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "_text": ["a bad baobab", "éx"]})
    met = [r for b in X._starts(every, [1, 3], 3, first)(iter([batch])) for r in b.to_pylist()]
    assert [(r["id"], r["rest"]) for r in met] == [(1, "bad"), (1, "bao"), (1, "bab"), (2, "x")]


def test_interval_join_bounds(spark):
    comments = spark.createDataFrame([("o", 1_000_000, 1)], "order_id string, ts bigint, comment_id int")
    at = [1_000_000 + d for d in (-600_001, -600_000, 0, 300_000, 300_001)]
    logs = spark.createDataFrame([("o", t, str(i), "ip") for i, t in enumerate(at)], "order_id string, ts bigint, log_id string, ip string")
    got = sorted(r["log_id"] for r in J.interval_join(comments, logs).collect())
    assert got == ["1", "2", "3"]


def test_sketches_of_slices_merge_into_any_window(spark):
    minute = 60_000
    rows = [("2024-01-01", m * minute, "ios", "b", "1", f"k{(m * 7 + i) % 300}") for m in range(120) for i in range(5)]
    rows += [("2024-01-01", 0, None, "b", "1", "x"), ("2024-01-01", 0, "ios", None, None, None), ("2024-01-01", 0, "ios", None, None, "y")]
    logs = spark.createDataFrame(rows, "log_date string, ts long, plat string, brand string, platv string, userkey string")
    slices = metrics.device_user_sketches(logs)
    for width in (10, 30, 120):
        start = (F.floor(F.col("slice_ms") / (width * minute)) * width * minute).alias("start")
        told = {r["start"]: r["users"] for r in metrics.sketched_users(slices, start).collect()}
        want = {}
        for _, ts, plat, *_, key in rows:
            if plat and key:
                want.setdefault(ts // (width * minute) * width * minute, set()).add(key)
        assert told.keys() == want.keys() and all(abs(told[k] - len(v)) <= 0.03 * len(v) for k, v in want.items())
    assert metrics.sketched_users(metrics.device_user_sketches(logs.limit(0)), "log_date").count() == 0
