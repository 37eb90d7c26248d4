"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3 after one warm-up; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from arealens.session import ensure_shared_folder, release, ship_package  # noqa: E402
from checks import load_checks  # noqa: E402
from checks.base import Tables  # noqa: E402

QUERIES = (
    "h5_rank_entities",
    "h6_rank_many",
    "h7_rank_stability",
    "e4_category_pivot",
    "e9_impute_hierarchical",
    "d1_spatial_join_within",
    "d3_assign_area",
    "q6_merge_features",
    "f1_rank_desc_whole_table",
    "h2_cosine_similarity",
    "k2_assign_nearest",
    "k8_k_sweep",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(ensure_shared_folder(spark))
    tables, checks, times = Tables(spark, folder), load_checks(), {}
    for name in QUERIES:
        fn, taken = checks[name][0], []
        for _ in range(runs + 1):
            start = time.perf_counter()
            fn(tables).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            release(spark)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
