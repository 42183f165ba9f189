"""Train-only statistics and their application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordered import wide_quantiles
from tidegauge.session import materialise


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def fit_scaler(train: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, feature, mean, scale)``: missing values ignored, population deviation, 0 becomes 1."""
    _require(train, features)
    stats = train.groupBy(*keys).agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in features]
    )
    return stats.unpivot(list(keys), list(features), "feature", "s").select(
        *keys,
        "feature",
        F.col("s.mean").alias("mean"),
        F.when(F.col("s.sd") == 0.0, 1.0).otherwise(F.col("s.sd")).alias("scale"),
    )


def _wide(stats: DataFrame, features: Sequence[str], keys: Sequence[str], *values: str) -> DataFrame:
    """One row per series with ``_<value>_<i>`` per feature; features are known, so no pivot scan."""
    return stats.groupBy(*keys).agg(
        *[
            F.any_value(F.when(F.col("feature") == c, F.col(v)), True).alias(f"_{v}_{i}")
            for i, c in enumerate(features)
            for v in values
        ]
    )


def apply_scaler(
    df: DataFrame,
    scaler: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    fill: float | None = None,
) -> DataFrame:
    """``(x - mean) / scale`` in place; ``fill`` replaces what is still missing.

    The statistics are one row per series; the join broadcasts them when they are small and
    is otherwise a skew-aware join on the series.
    """
    _require(df, features)
    stats = _wide(scaler, features, keys, "mean", "scale")
    scaled = {}
    for i, c in enumerate(features):
        value = (F.col(c) - F.col(f"_mean_{i}")) / F.col(f"_scale_{i}")
        scaled[c] = value if fill is None else F.coalesce(value, F.lit(float(fill)))
    return df.join(stats, list(keys), "left").withColumns(scaled).drop(*_added(stats, keys))


def _added(stats: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in stats.columns if c not in keys]


def train_medians(train: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, feature, median)``, exact."""
    _require(train, features)
    stored = materialise(train.select(*keys, *features))
    return wide_quantiles(stored, keys, features, [0.5]).select(*keys, "feature", F.col("q").alias("median"))


def impute(df: DataFrame, medians: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Missing features become the train median."""
    _require(df, features)
    stats = _wide(medians, features, keys, "median")
    filled = {c: F.coalesce(F.col(c), F.col(f"_median_{i}")) for i, c in enumerate(features)}
    return df.join(stats, list(keys), "left").withColumns(filled).drop(*_added(stats, keys))


def recode_label(column: str) -> Column:
    """{-1, 0, 1} to class index {0, 1, 2}."""
    return (F.col(column) + 1).cast("int")


def decode_label(column: str) -> Column:
    return F.col(column).cast("double") - 1.0
