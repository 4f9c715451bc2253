"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from sluice.plans import catalogue

HEADLINE = (
    "q_part_fnv",
    "q_set_distinct",
    "q_batch_take_n",
    "q_validate_dups",
    "q_merge_classify",
    "q_merge_result",
    "q_pack_files",
    "q_manifest_build",
    "q_queue_first_wins",
    "q_merge_multi_batch",
    "q_multi_source",
    "q_snapshot_read",
    "q_stream_ingest",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        taken[name] = round(statistics.median(times[1:]), 3)
        print(name, times, file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
