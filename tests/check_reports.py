"""Run registered queries against their SQL: check_reports.py [sf_dir] [name...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).parent)]

import oracle  # noqa: E402
from shopwake.reports import REPORTS  # noqa: E402
from shopwake.session import build_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = 0
    for name, r in REPORTS.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begun, spent = time.time(), 0.0
        try:
            df = r(spark, sf_dir).cache()
            df.count()
            spent = time.time() - begun
            if r.sql is None:
                text = f"rows only: {df.count()}"
                ok = True
            else:
                text = oracle.differences(df, con, r.sql)
                ok = not text
        except Exception as e:  # report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
            if wanted:
                traceback.print_exc()
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} spark {spent:.2f}s all {time.time() - begun:.2f}s {text[:1500]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
