"""Column functions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopwake.functions import comments as M, devices as D, logs as L, profiles as P
from shopwake.functions import regions as R, times, users as U


def values(spark, expression, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expression).collect()]


def test_epochs_in_seconds_and_milliseconds(spark):
    got = values(spark, times.epoch_ms("x"), [(1704067200,), (1704067200123,), (None,)], "x bigint")
    assert got == [1704067200000, 1704067200123, None]


def test_fraction_is_cut(spark):
    got = values(spark, times.whole_epoch("x"), [("1704067200.99",), ("x",), (None,)], "x string")
    assert got == [1704067200, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_local_date_turns_at_shanghai_midnight(spark, zone):
    midnight = 1704124800000  # 2024-01-01 16:00 UTC
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(midnight - 1,), (midnight,)]
        assert values(spark, times.local_date("x"), rows, "x bigint") == ["2024-01-01", "2024-01-02"]
        assert values(spark, times.local_hour("x"), rows, "x bigint") == [23, 0]
        assert values(spark, times.local_datetime("x"), rows, "x bigint") == [
            "2024-01-01 23:59:59",
            "2024-01-02 00:00:00",
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sales_event_time(spark):
    rows = [("1704067200.5", 7), ("1704067200123", 7), ("", 7), (None, 7), ("oops", 7)]
    ms = F.unix_millis(times.sales_event_time("ts", "i"))
    got = values(spark, ms, rows, "ts string, i bigint")
    assert got == [1704067200500, 1704067200123, 7, 7, None]


def test_event_time_helpers(spark):
    df = spark.createDataFrame(
        [('{"ts": 5000}', 7, None), ("{bad", None, 9)], "v string, block bigint, own bigint"
    )
    got = df.select(
        F.unix_millis(times.event_time_of_field("v", "ts")),
        F.unix_millis(times.event_time_of_block("block", "own")),
    ).collect()
    assert [tuple(r) for r in got] == [(5000, 7000), (0, 9000)]
    items = spark.createDataFrame([([(11,), (22,)],)], "w array<struct<window_start_time:bigint>>")
    assert items.select(F.unix_millis(times.event_time_of_first("w"))).first()[0] == 11


def test_json_logs_drop_malformed_lines(spark):
    lines = [
        '{"log_id":"a","ts":1704067200.9,"log_type":"search","keywords":["x"," ","null","y "],"gis":{"ip":"1.2.3.4"}}',
        '{"log_id":"b","ts":1704067200000,"keywords":"p, ,q,null"}',
        "{broken",
        "",
        None,
        "{}",
    ]
    parsed = L.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["log_id"]: r for r in parsed.collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["keywords"] == ["x", "y"] and got["b"]["keywords"] == ["p", "q"]
    assert got["a"]["ts"] == 1704067200 and got["a"]["ip"] == "1.2.3.4"
    assert got["b"]["brand"] is None


def test_device_names(spark):
    rows = [
        ("Adr 12", "x", None, "Android", "x"),
        ("other", "HONOR 9", None, "Android", "华为"),
        (None, None, "Mozilla iPad", "iOS", "unknown"),
        ("zzz", "acme", "zzz", "unknown", "acme"),
        ("MACOS", "Mi 10", None, "macOS", "小米"),
    ]
    df = spark.createDataFrame(rows, "plat string, brand string, ua string, p string, b string")
    got = df.select(
        D.platform(F.col("plat"), F.col("brand"), F.col("ua")), D.brand_name(F.col("brand")), "p", "b"
    ).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got), got


def test_regions_by_suffix(spark):
    rows = [
        ("中国|广东省深圳市|电信",),
        ("中国|广西自治区南宁|0",),
        ("中国|0|北京市|x",),
        ("中国|广东省|0",),
        ("0|0|lan",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "region string")
    got = [tuple(r) for r in df.select(*R.province_and_city(F.col("region"))).collect()]
    assert got == [
        ("广东省", "深圳市", "广东省深圳市"),
        ("广西自治区", "南宁", "广西自治区南宁"),
        ("北京市", "北京市", "北京市"),
        ("广东省", "广东省", "广东省"),
        ("未知", "未知", "未知"),
        ("未知", "未知", "未知"),
    ]


def test_ip_numbers(spark):
    rows = [("1.2.3.4",), ("1.2.3",), ("a.b.c.d",), (None,)]
    assert values(spark, R.ip_number(F.col("x")), rows, "x string") == [16909060, None, None, None]


def test_birthdays_and_signs(spark):
    rows = [("1993-02-30",), ("992-08-24",), ("1960-03-21",), ("2010-01-19",), ("1959-12-22",), (None,), ("2000-13-01",)]
    df = spark.createDataFrame(
        [(i, str(i), "n", "p", b, 1, "a", "2025-01-01 00:00:00") for i, (b,) in enumerate(rows)],
        "id int, user_id string, uname string, phone_num string, birthday string, gender int, address string, ts string",
    )
    got = {r["id"]: (r["birthday"], r["age_group"], r["constellation"], r["ts"]) for r in U.enrich(df).collect()}
    assert got == {
        0: (None, "90后", "双鱼", None),
        2: (dt.date(1960, 3, 21), "60后", "白羊", None),
        3: (dt.date(2010, 1, 19), "其他", "摩羯", None),
        4: (dt.date(1959, 12, 22), "其他", "摩羯", None),
    }


def test_every_zodiac_boundary(spark):
    starts = list(U.ZODIAC_STARTS.items())
    rows, want = [], []
    for i, (name, (m, d)) in enumerate(starts):
        rows += [(m, d), (m, d - 1)]
        want += [name, starts[i - 1][0]]
    assert values(spark, U.zodiac(F.col("m"), F.col("d")), rows, "m int, d int") == want


def test_age_counts_the_birthday_itself(spark):
    rows = [("2000-10-23",), ("2000-10-24",), ("bad",), (None,)]
    as_of = F.lit("2025-10-23").cast("date")
    assert values(spark, U.age_on(F.col("b"), as_of), rows, "b string") == [25, 24, 0, 0]


@pytest.mark.parametrize(
    "raw,comment,want",
    [
        ("12.50", "", 12.5),
        (" -3 ", "", -3.0),
        ("", "买了500元", None),
        ("null", "买了500元", None),
        ("AlmQ", "买了 1540 块", 1540.0),
        # two digits at most may follow a separator, so the match starts at 540
        ("AlmQ", "买了 1,540 块", 540.0),
        ("AlmQ", "花了50元", None),
        ("AlmQ", "50元 价格 300", 300.0),
        ("AlmQ", "200000 then 450", 450.0),
        ("AlmQ", "nothing", None),
        ("AlmQ", None, None),
        ("abcde", "500元", None),
        ("1234", "900元", 1234.0),
        (None, "900元", None),
    ],
)
def test_amounts(spark, raw, comment, want):
    got = values(spark, M.amount(F.col("r"), F.col("c")), [(raw, comment)], "r string, c string")
    assert got == [want]


def test_report_levels(spark):
    rows = [("台湾 垃圾",), ("SB",), ("fine",), (None,)]
    assert values(spark, M.report_level(F.col("c")), rows, "c string") == ["p1", "p2", "p3", "p3"]


def test_gbk_repair(spark):
    spoiled = "女士裤".encode("gbk").decode("iso-8859-1")
    assert values(spark, M.gbk_text("c"), [(spoiled,), (None,), ("abc",)], "c string") == ["女士裤", None, "abc"]


def test_amount_text(spark):
    rows = [(12.0,), (12.345,), (None,)]
    assert values(spark, M.amount_text(F.col("a")), rows, "a double") == ["12", "12.35", "0"]


def test_preferences_pass_over_known_categories(spark):
    rows = [(["yoga pants", "yoga pants", "shirt", "run"],), ([],)]
    got = values(spark, P.preferences(F.col("k")), rows, "k array<string>")
    assert (got[0]["categories"], got[0]["score"]) == (["yoga", "pants", "tops", "running"], 1.0)
    assert (got[1]["categories"], got[1]["score"]) == ([], 0.0)


def test_profile_bands(spark):
    one = spark.range(1)
    got = one.select(
        P.membership(F.lit(1500.0)), P.membership(F.lit(1500.01)), P.login_frequency(F.lit(5)),
        P.search_frequency(F.lit(99)), P.archetype(F.lit(True), F.lit(6), F.lit(10), F.lit(0.0)),
        P.archetype(F.lit(True), F.lit(5), F.lit(10), F.lit(1001.0)),
        P.engagement_score(F.lit(50), F.lit(1), F.lit(1)),
    ).first()
    assert tuple(got) == ("regular", "premium", "low", "high", "loyal_customer", "big_spender", 1.0)
