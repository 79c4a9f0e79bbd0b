"""Registered queries against their SQL on the smallest tables.

A cross-section by default; SHOPWAKE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry_module
import oracle
from shopwake.reports import REPORTS
from shopwake.session import compress_repeats

SF_DIR = "/root/testdata/sf0.001"
SOME = (
    "a1_daily_page_views a3_running_page_visits a12_session_report a14_platform_share a22_device_distributions "
    "a25_user_statistics j5_buffered_pairs j9_latest_state j11_lexicon_matches j12_joined_tokens p27_j7_city_dictionary "
    "p9_mixed_keyword_forms q1_j1_gmv_topn q5_p34_p36_moderation q6_p20_enriched_users t9_stream_cumulative_gmv w2_path_transitions"
).split()
NAMES = list(REPORTS) if os.environ.get("SHOPWAKE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_report(spark, con, name):
    report = REPORTS[name]
    df = report(spark, SF_DIR)
    if report.sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert oracle.differences(df, con, report.sql) == ""


def test_search_section_needs_no_comments(spark, con, tmp_path):
    os.symlink(f"{SF_DIR}/events.parquet", tmp_path / "events.parquet")
    report = REPORTS["a25_search_section"]
    assert oracle.differences(report(spark, str(tmp_path)), con, report.sql) == ""


def test_repeated_texts_take_little_room(spark, tmp_path):
    """Profiles of a comment's pairs repeat its text, so their files see further back than snappy; a caller's codec stays."""
    codec = "spark.sql.parquet.compression.codec"
    assert spark.conf.get(codec, None) is None
    try:
        profiles = REPORTS["q8_profiles_first_form"](spark, SF_DIR)
        profiles.write.parquet(str(tmp_path / "out"))
        assert list((tmp_path / "out").glob("*.zstd.parquet")) and not list((tmp_path / "out").glob("*.snappy.parquet"))
        spark.conf.set(codec, "gzip")
        compress_repeats(spark)
        assert spark.conf.get(codec) == "gzip"
    finally:
        spark.conf.unset(codec)


def test_entry_and_registry(spark, con):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
