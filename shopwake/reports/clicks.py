"""Click-log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import devices as D, logs as L, regions as R, times
from ..operators import geo, metrics, paths, sessions, shares
from ..sources.staging import staged
from .common import local_date, logs_with, utc_text, words_with
from .registry import report
from .tables import Tables


def _dated(t: Tables):
    return L.dated(t.logs)


def _utc(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@report(
    "p1_log_dates",
    logs_with() + "SELECT log_id, ts, log_date FROM d",
)
def p1(t):
    return _dated(t).select("log_id", "ts", "log_date")


@report("p2_log_times", logs_with() + "SELECT log_id, ts, log_time FROM d")
def p2(t):
    return L.timed(t.logs).select("log_id", "ts", "log_time")


@report(
    "p3_log_hours",
    logs_with()
    + "SELECT log_date, hour, count(*) AS events FROM d GROUP BY log_date, hour",
)
def p3(t):
    return L.timed(t.logs).groupBy("log_date", "hour").agg(F.count("*").alias("events"))


# The processing time is an argument here so that both sides agree.
_NOW = 1706745600000


@report(
    "p4_missing_ts_is_now",
    logs_with()
    + f"""SELECT log_id, coalesce(CASE WHEN ts < 1000000000000 THEN ts * 1000 ELSE ts END, {_NOW}) AS ts,
       {local_date(f"coalesce(CASE WHEN ts < 1000000000000 THEN ts * 1000 ELSE ts END, {_NOW})")} AS log_date
FROM logs""",
)
def p4(t):
    ms = times.epoch_ms_or_now("ts", F.lit(_NOW))
    return t.logs.select("log_id", ms.alias("ts")).withColumn(
        "log_date", times.local_date("ts")
    )


@report(
    "p5_log_defaults",
    logs_with()
    + """SELECT log_id, coalesce(user_id, 'anonymous') AS user_id, coalesce(brand, 'unknown') AS brand,
       coalesce(plat, 'unknown') AS plat, coalesce(device, 'unknown') AS device,
       coalesce(userkey, 'unknown') AS userkey, coalesce(opa, 'unknown') AS opa FROM logs""",
)
def p5(t):
    return L.with_defaults(t.logs).select(
        "log_id", "user_id", "brand", "plat", "device", "userkey", "opa"
    )


def _as_json(t: Tables):
    """Log lines as the topic carries them; every third ts is fractional, and
    every seventh is quoted."""
    device = F.struct("brand", "plat", "platv", "softv", "device", "userkey")
    fractional = F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("double") + 0.75)
    listed = F.to_json(F.col("keywords"))
    quoted = F.regexp_replace("value", r'"ts":([0-9.E+]+)', r'"ts":"$1"')
    lines = t.logs.select(
        "event_id",
        F.to_json(
            F.struct(
                "log_id",
                "log_type",
                "user_id",
                "order_id",
                "product_id",
                "opa",
                F.coalesce(fractional, F.col("ts").cast("double")).alias("ts"),
                # every fifth sender joins its words with commas
                F.when(F.col("event_id") % 5 == 0, F.array_join("keywords", ","))
                .otherwise(listed)
                .alias("keywords"),
                F.col("user_agent").alias("userAgent"),
                F.struct("ip").alias("gis"),
                device.alias("device"),
                "province",
                "city",
            )
        ).alias("value"),
    )
    return lines.select(
        F.when(F.col("event_id") % 7 == 0, quoted).otherwise(F.col("value")).alias("value")
    ).unionByName(
        # malformed lines, as many as there are signups
        t.logs.filter(F.col("log_type") == "login").select(
            F.concat(F.lit("{not json "), "log_id").alias("value")
        )
    )


@report(
    "p6_p7_parsed_json_logs",
    logs_with()
    + "SELECT log_id, log_type, user_id, ts, ip, brand, plat, platv, softv, device, userkey, user_agent FROM logs",
)
def p6_p7(t):
    """S3, P6, P7: malformed lines go, fractions are cut, nested fields come out."""
    return L.parse_logs(_as_json(t)).select(
        "log_id", "log_type", "user_id", "ts", "ip", "brand", "plat", "platv",
        "softv", "device", "userkey", "user_agent",
    )


@report(
    "p8_search_keywords",
    words_with() + "SELECT log_id, log_date, keyword FROM w",
)
def p8(t):
    return L.search_keywords(_dated(t)).select("log_id", "log_date", "keyword")


@report(
    "p9_mixed_keyword_forms",
    logs_with()
    + """, x AS (SELECT log_id, trim(unnest(keywords)) AS keyword FROM logs)
SELECT keyword, count(*) AS uses FROM x WHERE keyword <> '' AND keyword <> 'null' GROUP BY keyword""",
)
def p9(t):
    parsed = L.parse_logs(_as_json(t))
    return (
        parsed.select(F.explode("keywords").alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("uses"))
    )


@report(
    "p10_required_fields",
    logs_with()
    + "SELECT log_type, count(*) AS events FROM d WHERE log_type IS NOT NULL AND log_date IS NOT NULL GROUP BY log_type",
)
def p10(t):
    return L.required(_dated(t)).groupBy("log_type").agg(F.count("*").alias("events"))


@report(
    "p11_page_types",
    logs_with()
    + """SELECT log_id, log_type FROM d
WHERE log_type IN ('payment','page_view','click','view','search','login','product_list')""",
)
def p11(t):
    return L.page_types_only(_dated(t)).select("log_id", "log_type")


@report(
    "a1_daily_page_views",
    logs_with()
    + "SELECT log_date, log_type, count(*) AS pv FROM d GROUP BY log_date, log_type",
)
def a1(t):
    return metrics.daily_page_views(_dated(t))


@report(
    "a2_page_views_10s",
    logs_with()
    + f"""SELECT {utc_text('ts // 10000 * 10000')} AS window_start,
       {utc_text('ts // 10000 * 10000 + 10000')} AS window_end, log_date, log_type, count(*) AS pv
FROM d GROUP BY ts // 10000, log_date, log_type""",
)
def a2(t):
    return metrics.windowed_page_views(_dated(t)).withColumns(
        {"window_start": _utc("window_start"), "window_end": _utc("window_end")}
    )


@report(
    "a3_running_page_visits",
    logs_with()
    + """SELECT log_date AS ds, log_type AS page_name, ts, log_id,
       CAST(count(*) OVER (PARTITION BY log_date, log_type ORDER BY ts, log_id
             ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pv FROM d
WHERE log_type IN ('payment','page_view','click','view','search','login','product_list')""",
)
def a3(t):
    return metrics.running_page_visits(_dated(t))


@report(
    "a3_page_visit_totals",
    logs_with()
    + """SELECT log_date AS ds, log_type AS page_name, count(*) AS pv FROM d
WHERE log_type IN ('payment','page_view','click','view','search','login','product_list')
GROUP BY log_date, log_type""",
)
def a3_totals(t):
    return metrics.page_visit_totals(_dated(t))


@report(
    "a4_daily_search_words",
    words_with()
    + "SELECT log_date, keyword, count(*) AS search_count FROM w GROUP BY log_date, keyword",
)
def a4(t):
    return metrics.search_word_counts(_dated(t))


_TOP = (
    words_with()
    + """, c AS (SELECT log_date, keyword, count(*) AS n FROM w GROUP BY log_date, keyword),
r AS (SELECT log_date AS date, CAST(row_number() OVER (PARTITION BY log_date ORDER BY n DESC, keyword) AS INTEGER)
      AS rank, keyword, n AS search_count FROM c)
"""
)


@report("w6_top_search_words", _TOP + "SELECT * FROM r WHERE rank <= 10")
def w6(t):
    return metrics.top_search_words(_dated(t))


@report(
    "a27_daily_top_lists",
    _TOP
    + """SELECT date, string_agg(keyword || ':' || search_count, ',' ORDER BY rank) AS top_words
FROM r WHERE rank <= 10 GROUP BY date""",
)
def a27(t):
    return metrics.daily_top_lists(_dated(t))


@report(
    "a27_last_result_per_date",
    logs_with()
    + """, v AS (SELECT log_date AS date, ts, log_type,
      row_number() OVER (PARTITION BY log_date ORDER BY ts DESC, log_id DESC) AS rn FROM d)
SELECT date, log_type AS result FROM v WHERE rn = 1""",
)
def a27_last(t):
    rows = _dated(t).select(
        F.col("log_date").alias("date"),
        F.struct("ts", "log_id").alias("at"),
        F.col("log_type").alias("result"),
    )
    return metrics.last_per_date(rows, "result", ts="at")


_SUFFIX = """
ip AS (SELECT log_id, CASE WHEN regexp_full_match(ip, '([0-9]{1,2}|[01][0-9]{2}|2[0-4][0-9]|25[0-5])([.]([0-9]{1,2}|[01][0-9]{2}|2[0-4][0-9]|25[0-5])){3}') THEN
         (TRY_CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + TRY_CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
       + TRY_CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + TRY_CAST(split_part(ip, '.', 4) AS BIGINT)) END AS n, *
       EXCLUDE (log_id) FROM d WHERE ip <> ''),
g AS (SELECT ip.*, region FROM ip LEFT JOIN ip_ranges ON n BETWEEN start_ip AND end_ip),
a AS (SELECT *, list_filter(string_split(region, '|'), lambda p: contains(p, '省') OR contains(p, '自治区')
       OR contains(p, '市'))[1] AS addr FROM g),
s AS (SELECT *, CASE WHEN addr IS NULL THEN '未知'
       WHEN contains(addr, '省') THEN regexp_extract(addr, '^(.*?省)', 1)
       WHEN contains(addr, '自治区') THEN regexp_extract(addr, '^(.*?自治区)', 1) ELSE addr END AS prov FROM a),
f AS (SELECT *, CASE WHEN addr IS NULL THEN '未知' WHEN substr(addr, length(prov) + 1) = '' THEN prov
       ELSE substr(addr, length(prov) + 1) END AS cty FROM s)
"""


def _with_ip(t: Tables):
    rows = _dated(t).filter(F.col("ip").isNotNull() & (F.col("ip") != ""))
    return rows.drop("province", "city")


def _located(t: Tables):
    return geo.with_region(_with_ip(t), t.ip_ranges)


def _city_located(t: Tables):
    """Cities are looked up on the range table, once per range."""
    rows = geo.with_region(_with_ip(t), geo.with_dictionary_city(t.ip_ranges, t.cities))
    return rows.withColumns(
        {
            "province": F.coalesce("province", F.lit(geo.UNKNOWN_PROVINCE)),
            "city": F.coalesce("city", F.lit(geo.UNKNOWN_CITY)),
        }
    )


@report(
    "j8_ip_regions",
    logs_with("ip_ranges") + "," + _SUFFIX + "SELECT log_id, n AS ip_number, region FROM g",
)
def j8(t):
    return _located(t).select("log_id", "ip_number", "region")


@report(
    "p26_region_names",
    logs_with("ip_ranges")
    + ","
    + _SUFFIX
    + """SELECT log_id, prov AS province, cty AS city,
       CASE WHEN prov = cty THEN prov ELSE prov || cty END AS full_region FROM f""",
)
def p26(t):
    province, city, full = R.province_and_city(F.col("region"))
    return _located(t).select(
        "log_id",
        province.alias("province"),
        city.alias("city"),
        full.alias("full_region"),
    )


@report(
    "a5_login_region_heat",
    logs_with("ip_ranges")
    + ","
    + _SUFFIX
    + """SELECT log_date, prov AS province, cty AS city, count(*) AS visit_count
FROM f WHERE log_type = 'login' GROUP BY log_date, prov, cty""",
)
def a5(t):
    return geo.login_heat_by_ip(
        _dated(t), t.ip_ranges, ["province", "city"]
    ).orderBy("log_date", "province", "city")


@report(
    "a6_login_full_region_heat",
    logs_with("ip_ranges")
    + ","
    + _SUFFIX
    + """SELECT log_date, CASE WHEN prov = cty THEN prov ELSE prov || cty END AS full_region,
       count(*) AS visit_count FROM f WHERE log_type = 'login' GROUP BY ALL""",
)
def a6(t):
    return geo.login_heat_by_ip(_dated(t), t.ip_ranges, ["full_region"])


_CITY = """
rg AS (SELECT DISTINCT region FROM g),
cl AS (SELECT region, trim(replace(replace(replace(replace(region, '省', ''), '市', ''), '区', ''), '县', '')) AS c FROM rg),
m AS (SELECT region, city, province, row_number() OVER (PARTITION BY region ORDER BY length(city) DESC, city) AS rn
      FROM cl JOIN cities ON c <> '' AND (contains(c, city) OR contains(city, c))),
h AS (SELECT g.*  EXCLUDE (province, city), coalesce(m.province, '未知省') AS prov, coalesce(m.city || '市', '未知市') AS cty
      FROM g LEFT JOIN m ON g.region = m.region AND m.rn = 1)
"""


@report(
    "p27_j7_city_dictionary",
    logs_with("ip_ranges", "cities")
    + ","
    + _SUFFIX
    + ","
    + _CITY
    + "SELECT log_id, prov AS province, cty AS city FROM h",
)
def p27(t):
    return _city_located(t).select("log_id", "province", "city")


@report(
    "a7_known_region_heat",
    logs_with("ip_ranges", "cities")
    + ","
    + _SUFFIX
    + ","
    + _CITY
    + """SELECT log_date AS stat_date, prov AS province, cty AS city, count(*) AS visit_count FROM h
WHERE prov <> '未知省' AND cty <> '未知市' GROUP BY ALL""",
)
def a7(t):
    return metrics.known_region_heat(_city_located(t)).orderBy(
        "stat_date", "province", "city"
    )


_GIVEN = (
    logs_with()
    + """, h AS (SELECT log_date AS stat_date, province, city, count(*) AS visit_count FROM d
 WHERE trim(province) <> '' AND trim(city) <> '' GROUP BY ALL)
"""
)


@report("a8_given_region_heat", _GIVEN + "SELECT * FROM h")
def a8(t):
    return metrics.known_region_heat(_dated(t)).orderBy(F.col("visit_count").desc())


@report(
    "w7_top_regions",
    _GIVEN + "SELECT * FROM h ORDER BY visit_count DESC, stat_date, province, city LIMIT 10",
)
def w7(t):
    return metrics.top_regions(metrics.known_region_heat(_dated(t)))


_STEPS = (
    logs_with()
    + f""", p AS (SELECT user_id, ts, log_type, lag(log_type) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS prev
      FROM d WHERE user_id IS NOT NULL),
q AS (SELECT user_id, ts, {local_date('ts')} AS stat_date, prev || '→' || log_type AS path_sequence
      FROM p WHERE prev <> log_type)
"""
)


@report("w2_path_transitions", _STEPS + "SELECT * FROM q")
def w2(t):
    return paths.transitions(_dated(t))


@report(
    "a9_transition_counts",
    _STEPS
    + "SELECT stat_date, path_sequence, count(*) AS transition_count FROM q GROUP BY stat_date, path_sequence",
)
def a9(t):
    return paths.transition_counts(_dated(t))


@report(
    "w9_transitions_in_date_order",
    _STEPS
    + """SELECT stat_date || ' (' || path_sequence || ',' || count(*) || ')' AS line
FROM q GROUP BY stat_date, path_sequence""",
)
def w9(t):
    counts = paths.transition_counts(_dated(t)).orderBy("stat_date", "path_sequence")
    return counts.select(
        F.format_string("%s (%s,%d)", "stat_date", "path_sequence", "transition_count").alias("line")
    )


@report(
    "a10_sketched_device_users",
    logs_with()
    + """, u AS (SELECT log_date, plat, userkey FROM d WHERE userkey IS NOT NULL AND plat IS NOT NULL)
SELECT log_date, plat, count(DISTINCT userkey) AS users, true AS near FROM u GROUP BY log_date, plat
UNION ALL SELECT log_date, 'all', count(DISTINCT userkey), true FROM u GROUP BY log_date""",
)
def a10_sketched(t):
    """Users per day and platform and per day, merged from slices; ``near``: within 3 % of the exact count."""
    logs = _dated(t)
    sketches = staged(metrics.device_user_sketches(logs), "sketches")
    known = logs.filter(F.col("userkey").isNotNull() & F.col("plat").isNotNull())
    out = None
    for plat in (F.col("plat"), F.lit("all")):
        exact = known.groupBy("log_date", plat.alias("plat")).agg(F.count_distinct("userkey").alias("users"))
        told = metrics.sketched_users(sketches, "log_date", plat.alias("plat")).withColumnRenamed("users", "told")
        both = exact.join(told, ["log_date", "plat"], "left")
        near = F.coalesce(F.abs(F.col("told") - F.col("users")) <= 0.03 * F.col("users"), F.lit(False))
        part = both.select("log_date", "plat", "users", near.alias("near"))
        out = part if out is None else out.unionByName(part)
    return out


@report(
    "a10_device_users",
    logs_with()
    + """SELECT log_date, plat, brand, platv, count(DISTINCT userkey) AS users FROM d
WHERE userkey IS NOT NULL AND plat IS NOT NULL GROUP BY ALL""",
)
def a10(t):
    return metrics.device_users(_dated(t))


def _portrait_sql(window: str, key: str) -> str:
    return (
        logs_with()
        + f"""SELECT user_id, {window}
  CAST(count(DISTINCT CASE WHEN log_type = 'login' THEN log_date END) AS BIGINT) AS login_days,
  coalesce(string_agg(DISTINCT CASE WHEN log_type = 'login' THEN log_date END, ','
           ORDER BY CASE WHEN log_type = 'login' THEN log_date END), '') AS login_dates,
  coalesce(bool_or(log_type = 'payment'), false) AS has_payment, coalesce(bool_or(log_type = 'search'), false) AS has_search,
  coalesce(bool_or(log_type NOT IN ('login', 'payment', 'search')), false) AS has_browse,
  CASE WHEN bool_or(log_type = 'login') THEN min(hour) FILTER (WHERE log_type = 'login') || '点-'
       || max(hour) FILTER (WHERE log_type = 'login') || '点' ELSE '无登录' END AS login_time_range,
  CASE WHEN NOT bool_or(log_type = 'login') THEN '未知'
       WHEN max(hour) FILTER (WHERE log_type = 'login') <= 5 THEN '凌晨(1-5)'
       WHEN max(hour) FILTER (WHERE log_type = 'login') <= 12 THEN '早上(6-12)'
       WHEN max(hour) FILTER (WHERE log_type = 'login') <= 14 THEN '中午(12-14)'
       WHEN max(hour) FILTER (WHERE log_type = 'login') <= 18 THEN '下午(14-18)'
       ELSE '晚上(18-24)' END AS time_period
FROM (SELECT * REPLACE (coalesce(log_type, 'unknown') AS log_type) FROM d) WHERE user_id IS NOT NULL GROUP BY user_id{key}"""
    )


@report(
    "a11_user_portraits_30s",
    _portrait_sql(f"{utc_text('ts // 30000 * 30000 + 30000')} AS window_end,", ", ts // 30000"),
)
def a11(t):
    return metrics.user_portraits(L.timed(t.logs)).withColumn("window_end", _utc("window_end"))


@report("p31_p32_login_hours", _portrait_sql("", ""))
def p31(t):
    return metrics.user_portraits(L.timed(t.logs), width=None)


_VISITS = (
    logs_with()
    + """, v AS (SELECT user_id, ts, log_id, coalesce(log_type, 'unknown') AS page, coalesce(opa, 'unknown') AS action,
        lag(ts) OVER (PARTITION BY user_id ORDER BY ts, log_id) AS prev
      FROM d WHERE user_id IS NOT NULL AND user_id <> 'unknown'),
ss AS (SELECT *, max(CASE WHEN prev IS NULL OR ts - prev > 1800000 THEN ts END)
        OVER (PARTITION BY user_id ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS session_start FROM v)
"""
)


def _sessions(t: Tables):
    return sessions.with_sessions(sessions.visit_events(_dated(t)))


@report(
    "w3_session_split",
    _VISITS
    + """SELECT user_id, ts, log_id, page, action, session_start,
  row_number() OVER (PARTITION BY user_id, session_start ORDER BY ts, log_id) AS step FROM ss""",
)
def w3(t):
    return _sessions(t)


@report(
    "a12_session_report",
    _VISITS
    + f"""SELECT {local_date('session_start')} AS stat_date, user_id,
  user_id || '-' || session_start AS session_id,
  count(DISTINCT page) AS unique_pages, count(*) AS total_events,
  max(ts) - min(ts) AS total_duration,
  CASE WHEN count(*) > 1 THEN (max(ts) - min(ts)) // (count(*) - 1) ELSE 0 END AS avg_duration,
  min(ts) AS start_time, max(ts) AS end_time,
  CAST(count(*) <= 2 AS INTEGER) AS is_bounce,
  CAST(bool_or(page = 'checkout' OR action = 'payment') AS INTEGER) AS is_conversion
FROM ss GROUP BY user_id, session_start""",
)
def a12(t):
    return sessions.session_report(_sessions(t))


@report(
    "a12_session_steps",
    _VISITS
    + """SELECT user_id, user_id || '-' || session_start AS session_id,
  row_number() OVER (PARTITION BY user_id, session_start ORDER BY ts, log_id) AS step, page, action,
  strftime(make_timestamp(ts * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ss""",
)
def a12_steps(t):
    return sessions.session_steps(_sessions(t))


def _contains(column: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({column}, '{f}')" for f in fragments) + ")"


def _case(column: str, table) -> str:
    return (
        "CASE "
        + " ".join(f"WHEN {_contains(column, fr)} THEN '{name}'" for name, fr in table.items())
        + " END"
    )


_NAMES = f"""
n AS (SELECT log_id, ts, coalesce(userkey, 'unknown') AS device_id,
  coalesce({_case('lower(plat)', D.PLATFORM_BY_PLATFORM_TEXT)}, {_case('lower(brand)', D.PLATFORM_BY_BRAND)},
           {_case('lower(user_agent)', D.PLATFORM_BY_USER_AGENT)}, 'unknown') AS platform,
  CASE WHEN brand IS NULL OR trim(brand) = '' THEN 'unknown'
       ELSE coalesce({_case('trim(lower(brand))', D.BRAND_NAMES)}, brand) END AS brand,
  CASE WHEN device IS NULL OR trim(device) = '' THEN 'unknown' ELSE trim(device) END AS model
  FROM d),
fd AS (SELECT device_id, {local_date('ts')} AS stat_date, platform, brand, model FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, log_id) AS rn FROM n
  WHERE platform <> 'unknown' AND brand <> 'unknown' AND model <> 'unknown') WHERE rn = 1)
"""


@report(
    "p28_p30_device_names",
    logs_with() + "," + _NAMES + "SELECT log_id, platform, brand, model FROM n",
)
def p28(t):
    return _dated(t).select(
        "log_id",
        D.platform(F.col("plat"), F.col("brand"), F.col("user_agent")).alias("platform"),
        D.brand_name(F.col("brand")).alias("brand"),
        D.model_name(F.col("device")).alias("model"),
    )


@report("a13_new_devices", logs_with() + "," + _NAMES + "SELECT * FROM fd")
def a13(t):
    return shares.new_devices(_dated(t))


def _share_sql(within: str, name: str) -> str:
    return (
        logs_with()
        + ","
        + _NAMES
        + f"""SELECT {within}, {name}, count(*) AS device_count,
  CAST(round(CAST(count(*) * 100 AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {within}) + 1e-9, 2) AS DOUBLE) AS percentage
FROM fd GROUP BY {within}, {name}"""
    )


def _double_share(df):
    return df.withColumn("percentage", F.col("percentage").cast("double"))


@report("a14_platform_share", _share_sql("stat_date", "platform"))
def a14(t):
    return _double_share(shares.platform_share(shares.new_devices(_dated(t))))


@report("a15_brand_share", _share_sql("stat_date, platform", "brand"))
def a15(t):
    return _double_share(shares.brand_share(shares.new_devices(_dated(t))))


@report("a16_model_share", _share_sql("stat_date, platform, brand", "model"))
def a16(t):
    return _double_share(shares.model_share(shares.new_devices(_dated(t))))


@report(
    "w7_top_models",
    logs_with()
    + ","
    + _NAMES
    + """SELECT * FROM (SELECT stat_date, platform, brand, model, count(*) AS device_count,
  CAST(row_number() OVER (PARTITION BY stat_date ORDER BY count(*) DESC, platform, brand, model) AS INTEGER) AS rank
FROM fd GROUP BY stat_date, platform, brand, model) WHERE rank <= 20""",
)
def w7_models(t):
    return shares.top_models(shares.model_share(shares.new_devices(_dated(t)))).drop("percentage")


_DEVICES = (
    logs_with()
    + """, ud AS (SELECT * FROM (SELECT user_id, lower(brand) AS brand_key, lower(plat) AS plat_key, ts, log_id,
   brand, plat, platv, softv, device, userkey,
   row_number() OVER (PARTITION BY user_id, lower(brand), lower(plat) ORDER BY ts, log_id) AS rn
   FROM d WHERE user_id IS NOT NULL AND brand IS NOT NULL AND plat IS NOT NULL) WHERE rn = 1)
"""
)


@report("a21_user_devices", _DEVICES + "SELECT * EXCLUDE (rn) FROM ud")
def a21(t):
    return shares.user_devices(_dated(t))


@report(
    "a21_device_sets",
    _DEVICES
    + """SELECT user_id, count(*) AS devices, string_agg(brand || '/' || plat, ',' ORDER BY ts, log_id) AS names
FROM ud GROUP BY user_id""",
)
def a21_sets(t):
    return shares.device_sets(_dated(t)).select(
        "user_id",
        F.size("devices").cast("bigint").alias("devices"),
        F.array_join(
            F.transform("devices", lambda x: F.concat_ws("/", x["brand"], x["plat"])), ","
        ).alias("names"),
    )


@report(
    "a22_device_distributions",
    _DEVICES
    + """, b AS (SELECT user_id, string_agg(brand || '=' || n, ',' ORDER BY brand) AS brands, sum(n) AS total
   FROM (SELECT user_id, brand, count(*) AS n FROM ud GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT user_id, string_agg(plat || '=' || n, ',' ORDER BY plat) AS plats
   FROM (SELECT user_id, plat, count(*) AS n FROM ud GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, brands, plats, CAST(total AS BIGINT) AS total_devices,
  CASE WHEN total > 1 THEN 'multi_device' ELSE 'single_device' END AS device_usage_pattern
FROM b JOIN p USING (user_id)""",
)
def a22(t):
    def listed(column):
        entries = F.map_entries(column)
        return F.array_join(
            F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ","
        )

    return shares.device_distributions(_dated(t)).select(
        "user_id",
        listed("brand_distribution").alias("brands"),
        listed("plat_distribution").alias("plats"),
        "total_devices",
        "device_usage_pattern",
    )


@report(
    "a26_device_group_counts",
    _DEVICES
    + "SELECT brand_key || '_' || plat_key AS group_key, count(*) AS device_count FROM ud GROUP BY 1",
)
def a26(t):
    return shares.device_group_counts(_dated(t))
