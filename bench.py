"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8). Each
query runs once to warm up and then BENCH_RUNS times (default 2); the fastest run counts.
Building the plan is part of the time; results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "bars_ohlcv",
    "dedupe_quotes",
    "dense_grid",
    "audit_counts",
    "momentum",
    "volatility",
    "prepare_panel_full",
    "model_dataset_labeled",
    "model_table",
    "build_shared_table",
    "submission_issues",
    "daily_spearman",
    "trades",
    "benchmark_returns",
    "portfolio_metrics",
    "backtest_results",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sessiongrid-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from registry.spark_queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(min(taken[1:]), 3)
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
