"""Time-series feature building and forecast evaluation on Spark DataFrames."""

from tidegauge.operators.blocks import SeriesSpec

__all__ = ["SeriesSpec"]
