"""Zero, majority and autoregressive baselines."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.blocks import Blocked, SeriesSpec, Stages
from tidegauge.operators.lagsums import Ranges, range_sums, segment_sums
from tidegauge.session import ship_package

# fixed values: candidate orders
ORDERS = (1, 2, 3, 5)
CLASSES = (-1, 0, 1)


def zero_forecast() -> Column:
    return F.lit(0.0)


def majority_class(train: DataFrame, target: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, majority)``: the most frequent label, the smallest on ties."""
    counts = train.where(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.max_by(target, F.struct("n", (-F.col(target)).alias("low"))).alias("majority")
    )


def majority_columns() -> dict[str, Column]:
    """Prediction and one-hot probabilities from ``majority``."""
    one_hot = {
        f"p_{name}": (F.col("majority") == c).cast("double") for name, c in zip(("neg", "neu", "pos"), CLASSES, strict=True)
    }
    return {"y_pred": F.col("majority"), **one_hot}


def lagged_returns(b: Blocked, lags: int, close: str = "close") -> Stages:
    """1-bar log-returns ``_r0`` and their lags ``_r1 .. _r<lags>``."""
    return [
        {"_lc": F.ln(close)},
        {"_r0": b.diff("_lc", 1)},
        {f"_r{k}": b.lag("_r0", k) for k in range(1, lags + 1)},
    ]


def ar_products(lags: int = max(ORDERS)) -> dict[str, Column]:
    """Sums of the cross-products of ``(1, r, r_lag1 ..)``, upper triangle."""
    terms = ["1", *[f"_r{k}" for k in range(lags + 1)]]
    return {
        f"s_{i}_{j}": F.sum(F.expr(f"cast({left} as double) * {terms[j]}"))
        for i, left in enumerate(terms)
        for j in range(i, len(terms))
    }


def _all_known(rows: DataFrame, lags: int) -> DataFrame:
    return rows.dropna(subset=[f"_r{k}" for k in range(lags + 1)])


def ar_moments(rows: DataFrame, keys: Sequence[str], lags: int = max(ORDERS)) -> DataFrame:
    """Cross-product sums of ``(1, r, r_lag1 ..)`` over rows where all are known: one aggregate."""
    return _all_known(rows, lags).groupBy(*keys).agg(*[c.alias(name) for name, c in ar_products(lags).items()])


def ar_range_moments(rows: DataFrame, spec: SeriesSpec, ranges: Ranges, label: str = "fold", lags: int = max(ORDERS)) -> DataFrame:
    """``ar_moments`` of every row range of every series: the rows are read once, however many ranges there are."""
    products = ar_products(lags)
    return range_sums(segment_sums(_all_known(rows, lags), spec, products, ranges), spec, list(products), ranges, label)


def _weights(phi: np.ndarray, intercept: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """``cumulative_weights`` of every row of ``phi``.

    Each forecast is affine in the state, so the sum is too: iterate the companion map once.
    """
    p = phi.shape[1]
    state = np.tile(np.eye(p, p + 1, 1), (len(phi), 1, 1))  # rows: r_t, r_{t-1}, ..; column 0: constant
    total = np.zeros((len(phi), p + 1))
    for _ in range(horizon):
        ahead = np.einsum("si,sij->sj", phi, state)
        ahead[:, 0] += intercept
        total += ahead
        state = np.concatenate([ahead[:, None], state[:, :-1]], axis=1)
    return total[:, 0], total[:, 1:]


def cumulative_weights(phi: Sequence[float], intercept: float, horizon: int) -> tuple[float, np.ndarray]:
    """``(a, b)`` with sum of the next ``horizon`` forecasts = ``a + b . (r_t, r_{t-1}, ..)``."""
    a, b = _weights(np.asarray([phi], dtype=float), np.asarray([intercept]), horizon)
    return float(a[0]), b[0]


def _candidate(gram: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """``(aic, beta)`` of order ``p`` by least squares, for a batch of Gram matrices."""
    use = [0, *range(2, 2 + p)]
    n, right = gram[:, 0, 0], gram[:, use, 1]
    beta = np.einsum("sij,sj->si", np.linalg.pinv(gram[:, use][:, :, use], hermitian=True), right)
    rss = gram[:, 1, 1] - (beta * right).sum(1)
    return n * np.log(np.maximum(rss, 1e-300) / n) + 2 * (p + 2), beta


def fit_ar(moments: DataFrame, keys: Sequence[str], horizon: int = 24, orders: Sequence[int] = ORDERS) -> DataFrame:
    """``(keys, p, intercept, phi, aic, a, b)``: small solves, a batch of moment rows at a time.

    All orders are fitted on the common sample; the lowest AIC wins, the smaller order on ties.
    """
    lags, names = max(orders), list(keys)
    ranked, size = sorted(orders), lags + 2

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gram = np.zeros((len(batch), size, size))
            for i in range(size):
                for j in range(i, size):
                    gram[:, i, j] = gram[:, j, i] = batch[f"s_{i}_{j}"]
            aic, beta = np.zeros((len(ranked), len(batch))), np.zeros((len(ranked), len(batch), lags + 1))
            for k, p in enumerate(ranked):
                aic[k], beta[k, :, : p + 1] = _candidate(gram, p)
            best, rows = aic.argmin(0), np.arange(len(batch))
            p, chosen = np.asarray(ranked)[best], beta[best, rows]
            a, b = _weights(chosen[:, 1:], chosen[:, 0], horizon)
            cut = lambda x: [row[:n].tolist() for row, n in zip(x, p)]
            yield batch[names].assign(p=p, intercept=chosen[:, 0], phi=cut(chosen[:, 1:]), aic=aic[best, rows], a=a, b=cut(b))

    ship_package(moments.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in moments.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in names)
    return moments.mapInPandas(
        solve, f"{head}, p int, intercept double, phi array<double>, aic double, a double, b array<double>"
    )


def split_returns(b: Blocked, lags: int, close: str = "close") -> Stages:
    """Returns that restart at each split: 0 on its first row and before it."""
    return [
        {"_lc": F.ln(close)},
        {"_r0": F.when(F.col("split_row") == 0, 0.0).otherwise(b.diff("_lc", 1))},
        {
            f"_r{k}": F.when(F.col("split_row") >= k, F.coalesce(b.lag("_r0", k), F.lit(0.0))).otherwise(0.0)
            for k in range(1, lags)
        },
    ]


def ar_forecast(coefs: str = "", lags: int = max(ORDERS)) -> Column:
    """``a + sum b_j r_{t-j}`` from columns ``a``, ``b`` and ``_r0 ..``."""
    value = F.col(f"{coefs}a")
    for j in range(lags):
        value = value + F.coalesce(F.get(F.col(f"{coefs}b"), j) * F.col(f"_r{j}"), F.lit(0.0))
    return value


def forecast_threshold(b: Blocked, window: int = 24, horizon: int = 24, factor: float = 0.5) -> Stages:
    """Neutral zone of the AR classifier from the restarted returns; NULL in a split's warm-up."""
    return [
        {},
        {},
        {"_fv": b.std("_r0", window)},
        {"_fvl": b.lag("_fv", 1)},
        {"f_threshold": F.when(F.col("split_row") >= window, factor * F.col("_fvl") * math.sqrt(horizon))},
    ]


def forecast_label(y: Column, threshold: Column) -> Column:
    """Ternary label; a missing threshold gives 0."""
    return (
        F.when(threshold.isNotNull() & (y > threshold), 1.0)
        .when(threshold.isNotNull() & (y < -threshold), -1.0)
        .otherwise(0.0)
    )


def attach_forecast(
    indexed_splits: DataFrame,
    coefs: DataFrame,
    spec: SeriesSpec,
    horizon: int = 24,
    lags: int = max(ORDERS),
    vol_window: int = 24,
    factor: float = 0.5,
) -> DataFrame:
    """Forecast and label of every split row from fitted coefficients."""
    b = Blocked.of(indexed_splits, spec, back=max(lags, vol_window + 2))
    rows = b.run(split_returns(b, lags), forecast_threshold(b, vol_window, horizon, factor)).home()
    rows = rows.join(coefs.select(*spec.keys, "a", "b"), list(spec.keys), "left")
    rows = rows.where(F.col("split").isNotNull()).withColumn("y_pred", ar_forecast(lags=lags))
    return rows.withColumn("y_label", forecast_label(F.col("y_pred"), F.col("f_threshold")))
