"""Deterministic features of the timestamp (UTC), never shifted."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR = (
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "is_session_asia", "is_session_eu", "is_session_us",
)


def cyclic(name: str, value: Column, period: int) -> dict[str, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar_columns(ts: str = "ts") -> dict[str, Column]:
    """Cyclic hour, weekday (Monday 0) and month, and three overlapping sessions."""
    hour = F.hour(ts)
    # fixed values: session hours in UTC
    sessions = {
        "is_session_asia": (hour >= 23) | (hour < 8),
        "is_session_eu": (hour >= 7) & (hour < 16),
        "is_session_us": (hour >= 13) & (hour < 22),
    }
    return {
        **cyclic("hour", hour, 24),
        **cyclic("dow", F.weekday(ts), 7),
        **cyclic("month", F.month(ts) - 1, 12),
        **{name: flag.cast("tinyint") for name, flag in sessions.items()},
    }
