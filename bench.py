"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query is written to the no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from shopwake.reports import REPORTS
from shopwake.session import build_session, clear_shared

HEADLINE = (
    "a1_daily_page_views",
    "a2_page_views_10s",
    "a3_running_page_visits",
    "a5_login_region_heat",
    "a9_transition_counts",
    "a10_device_users",
    "a12_session_report",
    "a14_platform_share",
    "a24_search_history",
    "w6_top_search_words",
    "q1_j1_gmv_topn",
    "q6_p20_enriched_users",
    "q7_order_portraits",
    "j2_interval_join",
    "j5_buffered_pairs",
    "j9_latest_state",
    "j11_lexicon_matches",
    "q5_p34_p36_moderation",
    "t10_k4_stream_page_visits",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    REPORTS["a1_daily_page_views"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        REPORTS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
        clear_shared(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
