"""Forward-return targets with an adaptive neutral zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.technical import side_by_side
from tidegauge.operators.blocks import Blocked, Stages


def regression_target(b: Blocked, horizon: int = 24, close: str = "close") -> Stages:
    """``ln P[t+h] - ln P[t]``, NULL in the last ``horizon`` rows."""
    return [{"_lp": F.ln(close)}, {f"y_reg_h{horizon}": b.lead("_lp", horizon) - F.col("_lp")}]


def threshold(b: Blocked, horizon: int = 24, window: int = 24, factor: float = 0.5, close: str = "close") -> Stages:
    """Half-width of the neutral zone from returns up to ``t - 1`` only."""
    past = f"rv_past_{window}"
    return [
        {"_lp": F.ln(close)},
        {"_lr": b.diff("_lp", 1)},
        {"_vol": b.std("_lr", window)},
        {past: b.lag("_vol", 1)},
        {"y_clf_threshold": factor * F.col(past) * math.sqrt(horizon)},
    ]


def ternary(y: Column, width: Column) -> Column:
    """1 above the zone, -1 below, 0 inside, NULL if either side is missing."""
    known = y.isNotNull() & width.isNotNull()
    return (
        F.when(known & (y > width), 1.0)
        .when(known & (y < -width), -1.0)
        .when(known & (F.abs(y) <= width), 0.0)
    )


def target_stages(b: Blocked, horizon: int = 24, window: int = 24, factor: float = 0.5, close: str = "close") -> Stages:
    both = side_by_side(regression_target(b, horizon, close), threshold(b, horizon, window, factor, close))
    return [*both, {f"y_clf_h{horizon}": ternary(F.col(f"y_reg_h{horizon}"), F.col("y_clf_threshold"))}]
