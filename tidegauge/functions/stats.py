"""Aggregate expressions that stay defined on constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation over rows where both are known; NULL if either is constant."""
    cx = F.col(x) if isinstance(x, str) else x
    cy = F.col(y) if isinstance(y, str) else y
    both = cx.isNotNull() & cy.isNotNull()
    px, py = F.when(both, cx), F.when(both, cy)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def sample_skewness(x: Column | str) -> Column:
    """Bias-corrected skewness, NULL below 3 values."""
    n = F.count(x).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(F.count(x) >= 3, factor * F.skewness(x))


def sample_kurtosis(x: Column | str) -> Column:
    """Bias-corrected excess kurtosis, NULL below 4 values."""
    n = F.count(x).cast("double")
    factor = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(F.count(x) >= 4, factor * ((n + 1) * F.kurtosis(x) + 6.0))


def bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of ``x`` in ``[low, high]``, the last bin closed; one bin if flat."""
    place = F.floor(F.try_divide((x - low) * bins, high - low))
    return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))
