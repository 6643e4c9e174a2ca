"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (no collect to
the driver) three times; the per-query figure is the median.  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "person_features", "person_features_v1", "account_stats", "account_stats_long", "accounts",
    "streaks", "streaks_daily", "family_size", "serving_groups", "next_steps", "activation",
    "retention_days", "activation_rate", "stickiness", "wau_whole_weeks", "fivenum", "outlier_values",
    "hist30_by_key", "clean_people_literal", "stratified_split", "profile_numeric", "kde", "loess_series",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    from pyspark import __version__ as spark_version

    from flock.plans.registry import queries
    from flock.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    qs = queries()
    result = {}
    for name in names:
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        result[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(result.values()), 3),
                      "unit": "sec", "queries": result, "sf": sf, "cpus": cpus, "runs": runs,
                      "spark": spark_version}))


if __name__ == "__main__":
    main()
