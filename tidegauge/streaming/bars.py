"""The bar aggregate on an unbounded tick source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.bars import build_bars


def streaming_bars(
    ticks: DataFrame,
    *,
    key: str,
    ts: str,
    price: str,
    order: Column,
    width: str = "1 hour",
    lateness: str = "2 hours",
    volume: Column | None = None,
) -> DataFrame:
    """Bars of a tick stream; a bar is final once the watermark passes its end.

    State is one open row per series and step, so it is bounded by the lateness. Event time
    is an instant, so times without a zone are read in the session zone.
    """
    kind = ticks.schema[ts].dataType
    stamped = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    bars = build_bars(stamped, key=key, ts=ts, price=price, order=order, width=width, volume=volume)
    return bars if kind.simpleString() == "timestamp" else bars.withColumn("ts", F.col("ts").cast(kind))
