"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 2); the
median is reported.  Model fits run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowmill.functions.storage import sweep  # noqa: E402
from rowmill.plans.catalog import QUERIES  # noqa: E402
from rowmill.session import get_spark  # noqa: E402

HEADLINE = [
    "profile_numeric",
    "profile_categorical",
    "correlation",
    "quality_score",
    "duplicate_rows",
    "impute_auto",
    "iqr_filter",
    "scale_robust",
    "target_encode",
    "label_encode_part",
    "select_f_class",
    "split_stratified",
    "prep_chain",
    "class_metrics",
    "roc_auc",
    "reg_metrics",
    "davies_bouldin",
    "silhouette_exact",
    "best_models",
    "registry_state",
    "stream_serving_metrics",
    "linreg",
    "stream_alerts",
]
# Model fits: run once, without a warm-up.
HEAVY = ["kmeans", "forest_classifier", "logreg", "train_job"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark("rowmill-bench", f"local[{cpus}]", int(cpus), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in [*HEADLINE, *HEAVY]:
        times = []
        for _ in range(1 if name in HEAVY else runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    total = round(sum(seconds.values()), 3)
    sweep(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
