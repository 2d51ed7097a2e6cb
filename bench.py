"""Headline queries, timed once each after a warm-up; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the cores. The result of a query is written to Spark's no-op sink, so that all of it
is computed and none of it reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from mlscout.catalog import all_queries

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "profile_missing", "profile_numeric", "profile_categorical", "profile_top_values",
    "profile_outliers", "profile_correlations", "find_issues", "detect_task_regression",
    "impute", "cap_iqr", "clean_pipeline", "oversample_rows", "undersample_rows",
    "recipe_default_dummies", "recipe_prep", "split_rows_stratified", "fold_rows_plain",
    "metric_set_regression", "metric_set_binary", "metric_roc_auc_hand_till", "confusion",
    "homoscedasticity", "jarque_bera", "residual_bins", "sanitize", "html_escape",
    "nb_gaussian_predict", "ols_univariate", "knn_exact", "train_plain_regression",
    "train_lasso_regression", "train_tree_regression", "train_forest_regression",
    "train_naive_bayes", "compare_models", "validate_regression",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("mlscout-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("profile_numeric")  # starts the JVM's compilers
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER).removeprefix("sf"),
                "lineitem_rows": rows,
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
