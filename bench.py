"""Times headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from labelweave.checks.queries import QUERIES  # noqa: E402
from labelweave.session import build_session  # noqa: E402

#: The median of so many runs counts; no further run begins after so many seconds.
RUNS, LONG = 3, 10
HEADLINE = [
    "soft_clean", "full_clean", "overview", "dedupe_conflicts", "dedupe_multi", "removal_report",
    "class_distribution", "stratified_split_lines", "plain_split", "dense_id", "running_quantity", "seeded_shuffle",
    "nearest_label", "mean_word_vectors", "augment_all", "balance_all", "accept_similar", "language_id",
    "fixed_length_ids", "binary_metrics", "roc_points", "youden", "multiclass_metrics", "ovr_areas",
    "prepare_raw", "balance_training_binary", "judge_binary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_distribution"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < RUNS and sum(runs) < LONG:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
