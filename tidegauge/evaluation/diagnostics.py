"""The tables behind the usual evaluation figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.evaluation.metrics import CLASSES, NAMES, complete
from tidegauge.functions.stats import bin_index
from tidegauge.operators.blocks import ROW, Blocked, SeriesSpec
from tidegauge.operators.ordered import exact_quantiles


def monthly_accuracy(preds: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Share of right signs per month end; months without rows stay, with NULL."""
    hit = (F.signum("y_true") == F.signum("y_pred")).cast("double")
    months = (
        complete(preds).groupBy(*keys, F.last_day(ts).alias("month_end")).agg(F.avg(hit).alias("dir_acc"))
    )
    first, last = F.trunc(F.min("month_end"), "month"), F.trunc(F.max("month_end"), "month")
    spine = months.groupBy(*keys).agg(F.sequence(first, last, F.expr("interval 1 month")).alias("m"))
    spine = spine.select(*keys, F.explode("m").alias("m")).select(*keys, F.last_day("m").alias("month_end"))
    return spine.join(months, [*keys, "month_end"], "left")


def downsample(indexed: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row of each series, the first included."""
    return indexed.where(F.pmod(F.col(ROW), F.lit(step)) == 0)


def residual_trend(indexed: DataFrame, spec: SeriesSpec, step: int = 1) -> DataFrame:
    """Residuals, thinned, with a rolling mean over about a week.

    ``indexed`` holds complete predictions with their row numbers.
    """
    step = max(step, 1)
    window = max(168 // step, 12)
    thinned = downsample(indexed, step).withColumns(
        {
            ROW: F.floor(F.col(ROW) / step),
            "n_rows": F.ceil(F.col("n_rows") / step),
            "residual": F.col("y_true") - F.col("y_pred"),
        }
    )
    b = Blocked.of(thinned, spec, back=window - 1)
    return b.run([{"trend": b.mean_available("residual", window)}]).home().select(*spec.keys, spec.ts, "residual", "trend")


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """``(keys, bin, n, left_edge, density)`` for non-empty equal-width bins."""
    known = df.where(F.col(value).isNotNull())
    bounds = known.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        known.join(bounds, list(keys))
        .groupBy(*keys, bin_index(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("_lo", "_hi", "_n")])
        .select(
            *keys,
            "bin",
            "n",
            (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
            F.try_divide(F.col("n"), F.col("_n") * width).alias("density"),
        )
    )


def residual_histogram(preds: DataFrame, keys: Sequence[str], bins: int = 150) -> DataFrame:
    """Residual histogram with the mean and population deviation of the normal fit."""
    resid = complete(preds).withColumn("residual", F.col("y_true") - F.col("y_pred"))
    fit = resid.groupBy(*keys).agg(F.avg("residual").alias("mu"), F.stddev_pop("residual").alias("sigma"))
    return histogram(resid, keys, "residual", bins).join(fit, list(keys))


def density_grid(preds: DataFrame, keys: Sequence[str], bins: int = 50) -> DataFrame:
    """Counts on a square grid over predicted (x) and actual (y) values."""
    known = complete(preds)
    bounds = known.groupBy(*keys).agg(
        *[f(c).alias(f"_{c}_{n}") for c in ("y_true", "y_pred") for n, f in (("lo", F.min), ("hi", F.max))]
    )
    cell = {
        axis: bin_index(F.col(c), F.col(f"_{c}_lo"), F.col(f"_{c}_hi"), bins)
        for axis, c in (("x_bin", "y_pred"), ("y_bin", "y_true"))
    }
    return (
        known.join(bounds, list(keys))
        .groupBy(*keys, *[expr.alias(axis) for axis, expr in cell.items()])
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sign_quadrants(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by sign of prediction and outcome, zero counting as not positive."""
    yp, yt = F.col("y_pred") > 0, F.col("y_true") > 0
    return (
        complete(preds)
        .groupBy(*keys)
        .agg(
            F.count_if(yp & yt).alias("up_up"),
            F.count_if(~yp & yt).alias("down_up"),
            F.count_if(yp & ~yt).alias("up_down"),
            F.count_if(~yp & ~yt).alias("down_down"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("dir_acc", (F.col("up_up") + F.col("down_down")) / F.greatest(F.col("n"), F.lit(1)))
    )


def probability_boxes(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box statistics of each class probability per true class, whiskers at 1.5 box heights."""
    stacked = F.array(
        *[F.struct(F.lit(c).alias("label"), F.col(f"p_{n}").alias("p")) for c, n in zip(CLASSES, NAMES, strict=True)]
    )
    long = preds.where(F.col("y_true").isNotNull()).select(
        *keys, F.col("y_true").cast("int").alias("y_true"), F.inline(stacked)
    ).withColumnRenamed("p", "prob")
    group = [*keys, "y_true", "label"]
    quart = (
        exact_quantiles(long, group, "prob", [0.25, 0.5, 0.75])
        .groupBy(*group)
        .agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    prob = F.col("prob")
    return (
        long.join(quart, group)
        .groupBy(*group, "q1", "median", "q3")
        .agg(
            F.count("prob").alias("n"),
            F.min(F.when(prob >= F.col("q1") - reach, prob)).alias("low"),
            F.max(F.when(prob <= F.col("q3") + reach, prob)).alias("high"),
        )
    )


def top_importances(importances: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most important features of a ``(feature, importance)`` table."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def model_comparison(metrics: DataFrame, metric: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """One row per model, one column per split, from the metric ledger."""
    rows = metrics.where(F.col("metric") == metric)
    return rows.groupBy("model", "task").pivot("split", list(splits)).agg(F.max("value"))
