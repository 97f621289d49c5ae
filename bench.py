"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local
cores, ``BENCH_QUERIES`` an optional comma-separated list of name prefixes.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabwright.queries import QUERIES  # noqa: E402
from tabwright.session import local_session  # noqa: E402

HEADLINE = [
    "edit_add_formula", "edit_filter", "edit_batch", "merge_mean", "feat_generated", "feat_expand",
    "clean_drop_any", "clean_fill_mean", "clean_fill_median", "clean_fill_mode", "clean_outlier_iqr",
    "clean_outlier_zscore", "clean_onehot", "clean_label_encode", "clean_label_encode_large",
    "prof_numeric_stats", "prof_categorical_top10", "prof_describe", "prof_full", "prof_corr", "prof_outlier_counts",
    "eval_macro_prf", "eval_report", "eval_regression",
    "text_metrics", "text_json", "text_reasoning", "text_tool_calls", "text_code_issues",
    "mon_feature_stats", "mon_drift_score", "mon_rolling_rmse", "mon_running_drift", "mon_alerts", "mon_status",
    "ops_job_state", "ops_latest_by_type", "ops_scaling_efficiency", "ops_upsert_current", "ops_cache_status",
    "ml_split_exact", "ml_linreg", "ml_knn_exact", "ml_knn_classify", "ml_dtree", "ml_logreg", "ml_linear_svc",
    "ml_rf_classifier", "ml_gbt_classifier", "ml_rf_regressor", "ml_gbt_regressor", "ml_mlp", "ml_tune_grid",
    "src_csv_schema", "stream_feature_stats", "stream_monitor",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    chosen = os.environ.get("BENCH_QUERIES")
    names = [n for n in QUERIES if any(n.startswith(p) for p in chosen.split(","))] if chosen else HEADLINE
    # start the JVM, the Python workers and the scan code before the clock runs
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
