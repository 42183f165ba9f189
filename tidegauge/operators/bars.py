"""Ticks to bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arrival_order(*digits: tuple[Column, int]) -> Column:
    """Pack whole numbers, most significant first, into one decimal.

    Only for ticks without a unique sequence number: a long is several times cheaper. Each
    entry is ``(number, digits)``. A decimal is still a fixed-width aggregation buffer, so
    ``min_by``/``max_by`` stay in the hash aggregate, where a struct would force a sort of
    all ticks before the map-side combine.
    """
    left = sum(width for _, width in digits)
    if left > 38:
        raise ValueError("arrival order exceeds 38 digits")
    parts = []
    for number, width in digits:
        left -= width
        part = number.cast(f"decimal({width},0)")
        parts.append(part * F.lit(str(10**left)).cast(f"decimal({left + 1},0)") if left else part)
    return reduce(Column.__add__, parts)


def build_bars(
    ticks: DataFrame,
    *,
    key: str,
    ts: str,
    price: str,
    order: Column,
    width: str = "1 hour",
    volume: Column | None = None,
) -> DataFrame:
    """``(symbol, ts, open, high, low, close, volume, n_ticks)`` per series and time step.

    ``order`` ranks the ticks of a bar for open and close. It must be a fixed-width type and
    unique within a bar: a sequence number, or :func:`arrival_order`.

    One shuffle on (series, step), combined on the map side, so a series that owns a third
    of all ticks only sends one partial row per step and task.
    """
    volume = F.count(F.lit(1)).cast("double") if volume is None else F.sum(volume)
    return (
        ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
        .select(
            F.col(key).alias("symbol"),
            F.window(ts, width).alias("_w"),
            F.col(price).alias("_p"),
            order.alias("_o"),
            *[c for c in ticks.columns if c not in (key, ts, price, "symbol")],
        )
        .groupBy("symbol", "_w")
        .agg(
            F.min_by("_p", "_o").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_o").alias("close"),
            volume.alias("volume"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .select(
            "symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks"
        )
    )
