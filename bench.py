"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default all cores)
choose the data and the cores. Every query runs once to warm the JVM and is then timed into
a no-op sink, best of ``BENCH_RUNS`` (default 1).
"""

from __future__ import annotations

import json
import os
import time

from tidegauge.plans.catalog import QUERIES
from tidegauge.session import local_session

HEADLINE = (
    "ohlcv_bars", "daily_bars", "asof_multi", "log_returns", "rolling_zscore", "ema", "macd", "adx",
    "technical_features", "feature_matrix_full", "target_clf", "validation_report", "chrono_split",
    "walk_forward", "scaled_features", "sequences", "train_medians", "ar_fit", "ar_forecast",
    "ar_evaluation", "regression_metrics", "classification_metrics", "roc_auc", "feature_corr",
    "rf_regression", "gbt_regression",
)


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(min(timed(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
