"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and run to the end (all columns of all rows) from the parquet
files; results kept by one query are not used by another.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from trustframe import checks

HEADLINE = [
    "report", "dedupe", "class_distribution", "minmax_scale", "capped_sample", "stratified_split",
    "stratified_kfold", "bootstrap", "permute_labels", "f1_weighted", "roc_auc", "feature_scores",
    "cv_scores", "gnb_predict", "knn_minkowski", "tree_predict", "redundancy_probe", "perm_scores",
    "similarity_mean", "soft_vote", "dynamic_union", "budget_active",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks.load_all()
    wanted = sys.argv[1:] or HEADLINE
    checks.QUERIES["class_count"](spark, folder).collect()  # starts the session's executors
    times: dict[str, float] = {}
    for name in wanted:
        checks.forget()
        start = time.perf_counter()
        checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "lineitem_rows": lines, "cores": cores,
    }))


if __name__ == "__main__":
    main()
