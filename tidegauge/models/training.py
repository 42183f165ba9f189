"""Fit, predict on every split, measure and keep a ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.evaluation.metrics import CLASSIFICATION, REGRESSION, classification_metrics, regression_metrics
from tidegauge.models.base import Model, load_model
from tidegauge.operators.splits import ORDER, cv_folds
from tidegauge.session import materialise

RUN_SCHEMA = (
    "run_id string, model string, task string, target string, params map<string,string>, n_features int, "
    "n_train long, n_val long, n_test long, fit_seconds double, artifacts map<string,string>"
)
METRIC_COLUMNS = ("run_id", "model", "task", "split", "metric", "value")


def split_metrics(preds: DataFrame, task: str) -> DataFrame:
    """``(split, metric, value)`` for a table of predictions."""
    names = REGRESSION if task == "regression" else CLASSIFICATION
    wide = (regression_metrics if task == "regression" else classification_metrics)(preds, ["split"])
    return wide.unpivot(["split"], list(names), "metric", "value")


def evaluate(model: Model, df: DataFrame, keep: Sequence[str] = ("symbol", "ts")) -> tuple[DataFrame, DataFrame]:
    """Predictions of a fitted model on all split rows, and the metrics of each split."""
    rows = model.predict(df.where(F.col("split").isNotNull()))
    preds = materialise(
        rows.select(*keep, "split", F.col(model.target).alias("y_true"), F.col("y_pred").cast("double").alias("y_pred"))
    )
    return preds, split_metrics(preds, model.task)


def split_counts(preds: DataFrame) -> dict[str, int]:
    """Rows of each split."""
    counts = {r["split"]: r["count"] for r in preds.groupBy("split").count().collect()}  # at most three rows
    return {name: counts.get(name, 0) for name in ORDER}


def record(
    path: str, model: Model, preds: DataFrame, metrics: DataFrame, extra: dict[str, Any] | None = None, fit_seconds: float | None = None
) -> str:
    """Add a run to the ledger under ``path``: its model, predictions and metrics, then its row in ``runs``.

    The row of ``runs`` is written last and in one file. It is what makes a run count:
    readers leave out rows of runs without one, such as those of a job that died half way.
    """
    run, spark = uuid.uuid4().hex, preds.sparkSession
    tags = [F.lit(run).alias("run_id"), F.lit(model.name).alias("model"), F.lit(model.task).alias("task")]
    paths = {"model": f"{path}/models/{run}", "metrics": f"{path}/metrics", "predictions": f"{path}/predictions"}
    model.save(paths["model"])
    metrics.select(*tags, "split", "metric", "value").write.mode("append").parquet(paths["metrics"])
    preds.select(*tags, "*").write.mode("append").partitionBy("model", "task", "split").parquet(paths["predictions"])
    params = {**{k: str(v) for k, v in model.params.items()}, **{k: str(v) for k, v in (extra or {}).items()}}
    sizes = split_counts(preds)
    row = (run, model.name, model.task, model.target, params, len(model.features), *[sizes[s] for s in ORDER], fit_seconds, paths)
    runs = spark.createDataFrame([row], RUN_SCHEMA).withColumn("logged_at", F.current_timestamp())
    runs.coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return run


def train_and_evaluate(model: Model, df: DataFrame, ledger: str | None = None, extra: dict[str, Any] | None = None) -> DataFrame:
    """Fit, predict, measure; store the run and the model if a ledger folder is given."""
    start = time.perf_counter()
    model.fit(df)
    seconds = time.perf_counter() - start
    preds, metrics = evaluate(model, df)
    if ledger is not None:
        record(ledger, model, preds, metrics, extra, seconds)
    return metrics.select(F.lit(model.name).alias("model"), F.lit(model.task).alias("task"), "*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/runs")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all finished runs."""
    return spark.read.parquet(f"{path}/predictions").join(read_runs(spark, path).select("run_id"), "run_id", "left_semi")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of all finished runs."""
    stored = spark.read.parquet(f"{path}/metrics").select(*METRIC_COLUMNS)
    return stored.join(read_runs(spark, path).select("run_id"), "run_id", "left_semi")


def best_run(spark: SparkSession, path: str, metric: str, split: str = "val", task: str = "regression", largest: bool = False) -> Model:
    """The stored model of the finished run with the best value of a metric, the earliest on ties."""
    values = read_metrics(spark, path).where((F.col("metric") == metric) & (F.col("split") == split) & (F.col("task") == task))
    order = F.col("value").desc_nulls_last() if largest else F.col("value").asc_nulls_last()
    found = values.join(read_runs(spark, path).select("run_id", "logged_at", "artifacts"), "run_id")
    row = found.orderBy(order, "logged_at", "run_id").first()
    if row is None:
        raise ValueError(f"no finished {task} run with {metric} on {split} under {path}")
    return load_model(spark, row["artifacts"]["model"])


def learning_curve(build: Any, df: DataFrame, splits: int = 3, shares: Sequence[float] = (0.2, 0.36, 0.52, 0.68, 0.84, 1.0)) -> DataFrame:
    """Mean and deviation of train and validation RMSE per share of the train rows.

    ``df`` carries ``rn`` and ``n_rows``; ``build()`` makes an unfitted regression model.
    One model is fitted per fold and share.
    """
    scores = None
    for step, share in enumerate(shares):
        folds = materialise(cv_folds(df.drop("split"), splits, [share]).withColumn("split", F.col("role")))
        for fold in range(splits):
            rows = folds.where(F.col("fold") == fold)
            # the estimator sees train rows only; validation rows are for the score
            model = build().fit(rows.where("split = 'train'"))
            preds = model.predict(rows).withColumn("y_true", F.col(model.target))
            part = (
                preds.where(F.col("y_true").isNotNull())
                .groupBy("role")
                .agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)).alias("rmse"))
                .select(F.lit(step).alias("step"), F.lit(float(share)).alias("share"), F.lit(fold).alias("fold"), "role", "rmse")
            )
            part = materialise(part)
            scores = part if scores is None else scores.unionByName(part)
    return scores.groupBy("step", "share").agg(
        *[
            f(F.when(F.col("role") == role, F.col("rmse"))).alias(f"{role}_{name}")
            for role in ("train", "val")
            for name, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
