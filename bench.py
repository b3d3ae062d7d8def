"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
Each query runs once to its end on a warm session; its result is not collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from labelspring.checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "read_labelled",
    "class_index",
    "stratified_folds",
    "shuffle_splits",
    "pairs_shuffled",
    "pair_texts",
    "mlm_mask",
    "batches",
    "hashed_encode",
    "model_encode",
    "embed_join",
    "cosine_pair_loss",
    "in_batch_ranking_loss",
    "scaled_features",
    "projection_fit",
    "simcse_fit",
    "elastic_scores",
    "rf_scores",
    "gbm_scores",
    "pseudo_select",
    "pseudo_topk",
    "roc_auc",
    "fold_metrics",
    "self_training",
    "cv_baseline",
    "cv_two_stage",
    "cv_self_training",
    "cv_proper",
    "cv_oof",
    "cv_ensemble",
    "repeated_splits",
    "cv_frozen",
    "sweep",
    "fit_predict",
    "run_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("labelspring-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    with tempfile.TemporaryDirectory(prefix="labelspring-bench-") as shared:
        spark = builder.config("spark.checkpoint.dir", shared).getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        QUERIES["class_balance"](spark, folder).collect()
        QUERIES["model_encode"](spark, folder).limit(1).collect()  # start the Python workers
        seconds = {}
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        spark.stop()
    line = {
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
