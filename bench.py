"""Time the headline queries: one warm-up, then the median of three runs. Prints one JSON line.

The stand-in raw table is written before, as raw events would be; ``standin_sec`` is its time.
Everything else a query does, fitting and intermediate tables included, is in its seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from checks.standin import raw_events
from eventloom.session import scratch_tables

HEADLINE = [
    "raw_scan", "encoded_scan", "encoded_events", "actor_dictionary", "described_events",
    "class_histogram", "correlation_matrix", "feature_scores", "min_max_scaled",
    "holdout_split", "stratified_folds", "hashed_folds",
    "lag_windows", "lag_windows_blocks", "hot_actor_windows", "tail_holdout", "large_head",
]
# Training repeats passes over the same table; one run of each tells enough.
TRAINING = ["random_forest", "indexed_boosting", "dense_network", "sequence_network"]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    with scratch_tables(spark):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or [*HEADLINE, *TRAINING]
    start = time.perf_counter()
    raw_events(spark, sf_dir)
    standin, seconds = time.perf_counter() - start, {}
    for name in chosen:
        if name not in TRAINING:
            run(spark, name, sf_dir)
        runs = [run(spark, name, sf_dir) for _ in range(1 if name in TRAINING else 3)]
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "standin_sec": round(standin, 3),
                "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
