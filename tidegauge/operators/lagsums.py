"""Sums of products over lags and over row ranges, without a copy of the rows per lag or fold.

``lag_products`` multiplies the rows of a block with their shifted selves inside the block and
emits one row per block and lag. ``segment_sums`` totals any products between the borders of
blocks and ranges, so that ``range_sums`` answers every range, fold or expanding window from
a table with one row per segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.blocks import HOME, ROW, ROWS, Blocked, SeriesSpec
from tidegauge.session import ship_package

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
START = "seg_start"

#: a range of rows per name: first row and the row after the last, from the row count of the series
Ranges = Mapping[str | int, tuple[Column, Column]]


def _shifted(values: np.ndarray, lags: int) -> np.ndarray:
    """Row ``k`` holds ``values`` moved ``k + 1`` places on, zeros before."""
    padded = np.concatenate([np.zeros(lags), values])
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(values))
    return windows[lags - 1 :: -1][:lags]


def lag_products(b: Blocked, columns: Sequence[str], lags: int) -> DataFrame:
    """``(keys, block, column, lag, n, sx, sy, sxx, syy, sxy)`` with ``x`` at a row and ``y`` ``lag`` rows before.

    Pairs with a missing side do not count. A group is one block and its halo.
    """
    if lags > b.back:
        raise ValueError(f"{lags} lags need back >= {lags}, got {b.back}")
    keys, names = b.spec.block_keys, list(columns)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        home, parts = pdf[HOME].to_numpy(dtype=bool), []
        head = {k: pdf[k].iloc[0] for k in keys}
        for name in names:
            raw = pdf[name].to_numpy(dtype=float)
            there = np.isfinite(raw)
            y, y_there = np.where(there, raw, 0.0), there.astype(float)
            x, x_there = np.where(home, y, 0.0), np.where(home, y_there, 0.0)
            before, before_there = _shifted(y, lags), _shifted(y_there, lags)
            sums = (
                before_there @ x_there, before_there @ x, before @ x_there,
                before_there @ (x * x), (before * before) @ x_there, before @ x,
            )
            parts.append(pd.DataFrame({**head, "column": name, "lag": np.arange(1, lags + 1), **dict(zip(SUMS, sums, strict=True))}))
        return pd.concat(parts, ignore_index=True)

    ship_package(b.df.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in b.df.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "column string", "lag int", *[f"{s} double" for s in SUMS]])
    return b.df.select(*keys, ROW, HOME, *[F.col(c).cast("double") for c in names]).groupBy(*keys).applyInPandas(products, schema)


def correlation_of_sums() -> Column:
    """Pearson correlation from uncentred sums; NULL where a side is constant.

    Meant for columns whose mean is not far above their spread, such as returns: a spread
    below 1e-6 of the mean counts as constant.
    """
    xx, yy = F.col("n") * F.col("sxx"), F.col("n") * F.col("syy")
    vx, vy = xx - F.col("sx") * F.col("sx"), yy - F.col("sy") * F.col("sy")
    spread = (vx > xx * 1e-12) & (vy > yy * 1e-12)
    return F.when(spread, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))


def segment_sums(rows: DataFrame, spec: SeriesSpec, sums: Mapping[str, Column], ranges: Ranges) -> DataFrame:
    """``(keys, n_rows, seg_start, sums..)``: totals of the rows between two neighbouring borders.

    Borders are those of the blocks and of ``ranges``, so every range is a union of segments.
    """
    size = F.lit(spec.block_rows)
    edges = [edge for pair in ranges.values() for edge in pair]
    start = F.greatest(F.floor(F.col(ROW) / size) * size, *[F.when(F.col(ROW) >= e, e) for e in edges])
    return rows.groupBy(*spec.keys, ROWS, start.cast("bigint").alias(START)).agg(*[c.alias(name) for name, c in sums.items()])


def range_sums(segments: DataFrame, spec: SeriesSpec, names: Sequence[str], ranges: Ranges, label: str = "range") -> DataFrame:
    """``(keys, n_rows, label, names..)`` for every range that has rows: the sum of its segments.

    Work grows with segments times ranges, not with rows, and nothing is subtracted, so a
    short late range is as exact as a long one.
    """
    listed = F.array(*[F.struct(F.lit(name).alias(label), low.alias("low"), high.alias("high")) for name, (low, high) in ranges.items()])
    inside = F.filter(listed, lambda r: (F.col(START) >= r["low"]) & (F.col(START) < r["high"]))
    copies = segments.select(*spec.keys, ROWS, *names, F.explode(inside).alias("_r"))
    return copies.groupBy(*spec.keys, ROWS, F.col(f"_r.{label}").alias(label)).agg(*[F.sum(c).alias(c) for c in names])
