"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall times (seconds).

Each query is planned and fully executed into Spark's ``noop`` sink, so the
time covers the whole job (scans, shuffles, size checks) but no driver-side
collection of results.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "I1_stg_training_log", "I5_fct_training_set", "I6_m_progress_curve", "I7_m_last_training",
    "I8_m_ranking_weekly", "I9_m_ranking_monthly", "I10_m_ranking_alltime", "I11_m_ranking_bodypart",
    "I12_m_personal_record", "I13_m_calendar", "E1_dedup_latest", "J4_incremental_staging",
    "J5_incremental_fact", "J1_explode_documents", "L7_documented_suite", "M5_daily_plan",
    "N1_current_week", "N16_exercise_history", "O1_training_pairs", "O7_fallback_suggest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    from liftlake.session import get_spark
    from liftlake.plans.catalog import QUERIES
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="liftlake-bench")
    names = [n for n in HEADLINE if n in QUERIES]
    # warm-up (not timed, not a headline query): loads the JVM classes of
    # scans, joins and aggregates once so the first timed query is not
    # charged for them
    QUERIES["A1_scan_training_log"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
