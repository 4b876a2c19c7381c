"""Prints one JSON line: seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pyspark.sql import SparkSession

from sievespark.plans.queries import QUERIES

HEADLINE = [
    "upload_batch_words", "upload_catalog", "filter_meta", "set_and", "set_or", "set_andnot", "set_xor", "multi_and_3", "multi_and_8", "multi_and_chain", "multi_and_builtin", "multi_or",
    "multi_and_mixed_negation", "multi_and_all_negated", "multi_and_grouped", "contains_probe", "contains_batch", "enumerate_ids", "enumerate_indptr", "decompress_dense", "decompress_batch",
    "promote_roundtrip", "complement_words", "tag_query_ids", "tag_query_members", "knn_prefilter", "knn_all", "knn_through_filter", "recall_at_k", "csr_lists", "stats_summary",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 4)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(found[1]) if found else None, "runs": RUNS}))


if __name__ == "__main__":
    main()
