"""Both profile forms, field by field, so that SQL can check what their JSON holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles as P
from . import pairs as PR, profiles as R
from .common import logs_with
from .records import _USERS
from .registry import REPORTS, report
from .remarks import _FOUND, _HIST, _NOT_BLANK, _ROWS
from .tables import Tables

DAY = "2025-10-23"
NOW = f"{DAY} 12:00:00"

# Profiles are made of comments with a text.
_PAIRS = PR.SIGNIFICANT_SQL.replace("0 AS fresh FROM comments", f"0 AS fresh FROM comments WHERE {_NOT_BLANK}")

# One row per reported pair, with all facts that a field is made of.
_FACTS = f"""WITH sig AS ({_PAIRS} SELECT user_id, at_ts, at_tag, at_id, device_count, comment_id, log_id, log_no FROM k JOIN walk USING (user_id, r) WHERE told),
lo AS ({REPORTS['a23_login_history'].sql}),
se AS ({REPORTS['a24_search_history'].sql}),
pf AS ({REPORTS['p46_category_preferences'].sql}),
rem AS ({_ROWS}, {_FOUND}, {_HIST} SELECT det.doc_id, det.ts AS c_ts, det.ds AS c_ds, det.order_id AS c_order, det.product_id AS c_product, det.amount, det.comment,
  det.is_sensitive, det.sensitive_level, det.triggered_keyword, b.consumption_level,
  CASE det.sensitive_level WHEN 'P0' THEN 365 WHEN 'P1' THEN 60 ELSE 0 END AS ban_days,
  CASE WHEN regexp_matches(lower(det.comment), '女生|女士|女款|女性') THEN 'female' WHEN regexp_matches(lower(det.comment), '男生|男士|男款|男性') THEN 'male' ELSE 'unknown' END AS for_whom
  FROM det JOIN b USING (doc_id)),
lg AS ({logs_with()} SELECT log_id, ts AS l_ts, log_time AS l_time, log_type, order_id AS l_order, product_id AS l_product, ip,
  list_filter(list_transform(keywords, lambda x: trim(x)), lambda x: x <> '' AND x <> 'null') AS kw FROM d),
us AS ({_USERS} SELECT user_id, uname, birthday, gender AS sex, age_group, constellation FROM en),
fa AS (SELECT sig.*, rem.* EXCLUDE (doc_id), lg.* EXCLUDE (log_id), us.* EXCLUDE (user_id),
  recent_logins, coalesce(login_count, 0) AS l, coalesce(last_login, '') AS last_login, shown_keywords, coalesce(search_count, 0) AS w,
  coalesce(unique_search_count, 0) AS uw, coalesce(search_sessions, 0) AS s, coalesce(last_search_time, '') AS last_search_time,
  coalesce(pf.categories, '') AS categories, coalesce(pf.score, 0.0) AS score,
  coalesce(year(DATE '{DAY}') - year(CAST(birthday AS DATE)) - CAST(month(DATE '{DAY}') * 100 + day(DATE '{DAY}') < month(CAST(birthday AS DATE)) * 100 + day(CAST(birthday AS DATE)) AS INTEGER), 0) AS age,
  list_distinct(list_filter([c_order, l_order], lambda x: x IS NOT NULL)) AS orders,
  coalesce(login_count, 0) + coalesce(search_sessions, 0) > 0 AS past, coalesce(triggered_keyword, '') AS bad_word,
  CASE sex WHEN 1 THEN '男' WHEN 0 THEN '女' ELSE '未知' END AS sex_label, constellation || '座' AS sign
  FROM sig JOIN rem ON rem.doc_id = sig.comment_id JOIN lg ON lg.log_id = sig.log_id JOIN us ON us.user_id = sig.user_id
  LEFT JOIN lo ON lo.user_id = sig.user_id LEFT JOIN se ON se.user_id = sig.user_id LEFT JOIN pf ON pf.user_id = sig.user_id)
SELECT user_id AS userid, at_ts, at_tag, at_id, log_no, """


def _text(array):
    return F.coalesce(F.array_join(array, ","), F.lit(""))


def _pairs_text(map_):
    entry = F.transform(F.array_sort(F.map_entries(map_)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return _text(entry)


@report(
    "q9_p49_profile_fields",
    _FACTS
    + """uname AS username, coalesce(birthday, '') AS birthday, age_group AS decade, sex_label AS gender, sign AS zodiac_sign, age,
CASE WHEN amount > 1500 THEN 'premium' WHEN amount > 500 THEN 'regular' ELSE 'new' END AS membership_level,
coalesce(recent_logins, '') AS recent_logins, l AS login_count, last_login,
CASE WHEN l >= 50 THEN 'very_high' WHEN l >= 20 THEN 'high' WHEN l >= 10 THEN 'medium' WHEN l >= 5 THEN 'low' ELSE 'very_low' END AS login_frequency,
lower(consumption_level) AS consumption_level, coalesce(amount, 0.0) AS avg_order_value,
CAST(c_order IS NOT NULL AS INTEGER) + CAST(l_order IS NOT NULL AS INTEGER) AS total_orders,
CASE WHEN amount > 1500 THEN 'high_potential' WHEN amount > 500 THEN 'medium' ELSE 'low' END AS lifetime_value,
device_count AS total_devices, CASE WHEN device_count > 1 THEN 'multi_device' WHEN device_count = 1 THEN 'single_device' ELSE 'unknown' END AS device_usage_pattern,
coalesce(shown_keywords, '') AS search_keywords, w AS search_count, uw AS unique_search_count, s AS search_sessions, last_search_time,
CASE WHEN s = 0 THEN 'none' WHEN w >= 100 THEN 'very_high' WHEN w >= 50 THEN 'high' WHEN w >= 20 THEN 'medium' WHEN w >= 5 THEN 'low' ELSE 'very_low' END AS search_frequency,
categories AS browsed_categories, score AS preference_score, CASE WHEN categories = '' THEN 0 ELSE len(string_split(categories, ',')) END AS interest_diversity,
for_whom AS gender_preference, list_aggregate(list_sort(orders), 'string_agg', ',') AS order_ids,
CASE WHEN len(orders) > 1 THEN 'frequent' ELSE 'occasional' END AS shopping_style,
bad_word AS triggered_keywords, CAST(CASE WHEN bad_word <> '' THEN 0.5 ELSE 0.1 END AS DOUBLE) AS risk_score,
CASE WHEN bad_word <> '' THEN 'medium' ELSE 'high' END AS trust_level, ban_days,
CASE WHEN l >= 10 OR s >= 20 THEN 'high' WHEN l >= 5 OR s >= 10 THEN 'medium' ELSE 'low' END AS activity_level,
CASE WHEN amount > 1000 THEN 'high' WHEN amount > 500 THEN 'medium' ELSE 'low' END AS user_value,
CAST(round(least((l * 0.3 + s * 0.5 + device_count * 0.2) / 10, 1.0), 6) AS DOUBLE) AS engagement_score,
CASE WHEN NOT past THEN 'new_user' WHEN s > 10 THEN 'researcher' WHEN l > 5 THEN 'loyal_customer' WHEN amount > 1000 THEN 'big_spender' ELSE 'casual_shopper' END AS shopping_archetype,
c_ds AS ds, CAST(c_ts AS STRING) AS ts, CASE WHEN past THEN 'comment,log,user_info,behavior_history' ELSE 'comment,log,user_info' END AS data_sources,
CASE WHEN past THEN 'batch_daily' ELSE 'realtime' END AS update_type FROM fa""",
)
def q9_fields(t: Tables):
    """The sections of the current profile form, one column per field."""
    p = R.current_profiles(t, DAY)
    base, login, money = "user_base_info", "login_activity", "financial_profile"
    search, likes, shop = "search_behavior", "category_preferences", "shopping_profile"
    plain = {
        base: ["birthday", "decade", "gender", "zodiac_sign", "age", "membership_level"],
        login: ["login_count", "last_login", "login_frequency"],
        money: ["consumption_level", "avg_order_value", "total_orders", "lifetime_value"],
        "device_analysis": ["device_usage_pattern"],
        search: ["search_count", "unique_search_count", "search_sessions", "last_search_time", "search_frequency"],
        likes: ["preference_score", "interest_diversity"],
        shop: ["gender_preference", "shopping_style"],
        "risk_management": ["risk_score", "trust_level", "ban_days"],
        "behavior_insights": ["activity_level", "user_value", "shopping_archetype"],
        "metadata": ["ds", "ts", "update_type"],
    }
    return p.select(
        "userid", *PR.J.EMISSION, "username",
        *[f"{section}.{field}" for section, fields in plain.items() for field in fields],
        _text(F.col(f"{login}.recent_logins")).alias("recent_logins"),
        F.col("device_analysis.total_devices").cast("bigint").alias("total_devices"),
        _text(F.col(f"{search}.search_keywords")).alias("search_keywords"),
        _text(F.col(f"{likes}.browsed_categories")).alias("browsed_categories"),
        F.nullif(_text(F.sort_array(f"{shop}.order_ids")), F.lit("")).alias("order_ids"),
        _text(F.col("risk_management.triggered_keywords")).alias("triggered_keywords"),
        F.round("behavior_insights.engagement_score", 6).alias("engagement_score"),
        _text(F.col("metadata.data_sources")).alias("data_sources"),
    )


_FAMILY = "CASE " + " ".join(f"WHEN contains(l_product, '{part}') THEN '{name}'" for name, part in P.PRODUCT_FAMILIES.items()) + " END"


@report(
    "q8_profile_fields",
    _FACTS
    + f"""uname AS username, '{DAY}' AS date, c_ds AS ds, CAST(c_ts AS STRING) AS ts, CAST(age AS STRING) AS age, sex_label AS gender,
coalesce(log_type, '') AS all_behavior_types, coalesce(log_type || '=1', '') AS behavior_counts,
CASE WHEN log_type = 'search' THEN coalesce(list_aggregate(kw, 'string_agg', ','), '') ELSE '' END AS all_searched_keywords,
CASE WHEN log_type = 'search' THEN CAST(coalesce(len(kw), 0) AS INTEGER) ELSE 0 END AS total_searched_keywords,
CASE WHEN log_type = 'search' THEN CAST(coalesce(len(list_distinct(kw)), 0) AS INTEGER) ELSE 0 END AS different_keywords,
sensitive_level, is_sensitive AS is_insulting, comment, coalesce(c_product, '') AS product_name,
strftime(make_timestamp(c_ts * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS first_comment, l_time AS first_activity,
CAST(is_sensitive AS INTEGER) AS insulting_comments, 1 - CAST(is_sensitive AS INTEGER) AS positive_comments,
CASE WHEN bad_word <> '' THEN '1' ELSE '0' END AS is_check_sensitive_comment, bad_word AS sensitive_word,
coalesce(amount, 0.0) AS total_order_amount, CAST(amount IS NOT NULL AS INTEGER) AS order_count,
coalesce(l_product, '') AS viewed_products, coalesce({_FAMILY}, '') AS product_categories,
device_count AS devices, coalesce(ip, '') AS ips, CASE WHEN ip IS NULL THEN '' ELSE 'unknown' END AS networks,
coalesce(nullif(recent_logins, ''), CASE WHEN log_type = 'login' THEN l_time END, '') AS login_time,
lower(consumption_level) AS consumption_level, CASE for_whom WHEN 'female' THEN '女' WHEN 'male' THEN '男' ELSE 'unknown' END AS shopping_gender,
coalesce(list_aggregate(list_sort(orders), 'string_agg', ','), '') AS shopping_id, '{NOW}' AS process_time, c_ts AS data_timestamp FROM fa""",
)
def q8_fields(t: Tables):
    """The sections of the first profile form, one column per field."""
    p = R.first_profiles(t, NOW)
    info, s = "user_info.user_base_info", "statistics"
    remark = F.col(f"{s}.comment_analysis.all_comments")[0]
    lists = {
        "all_behavior_types": f"{s}.behavior_analysis.all_behavior_types",
        "all_searched_keywords": f"{s}.search_analysis.all_searched_keywords",
        "sensitive_word": f"{s}.comment_analysis.sensitive_word",
        "viewed_products": f"{s}.product_analysis.viewed_products",
        "product_categories": f"{s}.product_analysis.product_categories",
        "ips": f"{s}.environment_analysis.ips",
        "networks": f"{s}.environment_analysis.networks",
        "login_time": f"{s}.time_analysis.login_time",
    }
    return p.select(
        "userid", *PR.J.EMISSION, "user_info.username", "date", "ds", "ts", f"{info}.age", f"{info}.gender",
        *[_text(F.col(path)).alias(name) for name, path in lists.items()],
        _pairs_text(F.col(f"{s}.behavior_analysis.behavior_counts")).alias("behavior_counts"),
        f"{s}.search_analysis.total_searched_keywords",
        F.size(f"{s}.search_analysis.search_counts").alias("different_keywords"),
        remark["sensitive_level"].alias("sensitive_level"), remark["is_insulting"].alias("is_insulting"),
        remark["comment"].alias("comment"), remark["product_name"].alias("product_name"),
        f"{s}.time_analysis.first_comment", f"{s}.time_analysis.first_activity",
        f"{s}.comment_analysis.insulting_comments", f"{s}.comment_analysis.positive_comments",
        f"{s}.comment_analysis.is_check_sensitive_comment",
        f"{s}.order_analysis.total_order_amount", f"{s}.order_analysis.order_count",
        F.coalesce(F.size(f"{s}.environment_analysis.devices"), F.lit(0)).cast("bigint").alias("devices"),
        "consumption_level", F.col("shopping_gender.gender").alias("shopping_gender"),
        _text(F.sort_array("shopping_gender.shopping_id")).alias("shopping_id"), "process_time", "data_timestamp",
    )
