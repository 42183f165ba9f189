"""Windows by reference: rows stored once in blocks, a window as block and offset.

A table of whole windows holds every row ``lookback`` times. Here a window is a row of
``windows`` with its block and the offset of its last row; ``rows`` has one row per block with
the features of the block's rows, row after row. ``map_windows`` puts the two together block
by block, across block borders, and hands a function one bounded batch of windows at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.blocks import BLOCK, ROW, SeriesSpec, shuffle_width
from tidegauge.session import ship_package

OFFSET = "_offset"
_INTO = "_into"

#: gets the columns of some windows and their rows, shaped (windows, lookback, features)
WindowFunction = Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]


def _block_of(spec: SeriesSpec) -> Column:
    return F.floor(F.col(ROW) / F.lit(spec.block_rows)).cast("bigint")


def write_window_store(
    indexed: DataFrame, spec: SeriesSpec, features: Sequence[str], keep: Sequence[str], target: str, path: str, lookback: int = 168
) -> str:
    """Store ``rows``, ``windows`` and, last, their ``layout`` under ``path``.

    A window ends at every row with a target and ``lookback - 1`` rows before it. Features
    are stored as floats, missing ones as NULL. ``indexed`` is read twice.
    """
    if lookback < 1:
        raise ValueError("lookback must be at least 1")
    block = _block_of(spec).alias(BLOCK)
    values = F.struct(F.col(ROW).alias("r"), F.array(*[F.col(c).cast("float") for c in features]).alias("v"))
    one = indexed.select(*spec.keys, block, values.alias("row")).repartition(shuffle_width(indexed), *spec.block_keys)
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["v"]))
    one.groupBy(*spec.block_keys).agg(ordered.alias("x")).write.mode("overwrite").parquet(f"{path}/rows")
    windows = indexed.where((F.col(ROW) >= lookback - 1) & F.col(target).isNotNull())
    offset = (F.col(ROW) % F.lit(spec.block_rows)).cast("int").alias(OFFSET)
    windows.select(*spec.keys, spec.ts, *keep, block, offset).write.mode("overwrite").parquet(f"{path}/windows")
    layout = {"lookback": lookback, "features": list(features), "block_rows": spec.block_rows, "keys": list(spec.keys)}
    text = indexed.sparkSession.createDataFrame([(json.dumps(layout),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/layout")
    return path


def read_layout(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/layout").first()[0])


def map_windows(spark: SparkSession, path: str, function: WindowFunction, schema: str, batch: int = 512, where: str | None = None) -> DataFrame:
    """``function`` over all windows, or those that fulfil ``where``, at most ``batch`` of one block at a time.

    A block's rows go to the block itself and to the few blocks whose windows reach back into
    it, so the rows are copied twice for windows shorter than a block, whatever the lookback.
    """
    layout = read_layout(spark, path)
    lookback, width, size, keys = layout["lookback"], len(layout["features"]), layout["block_rows"], layout["keys"]
    reach = -(-(lookback - 1) // size)
    windows = spark.read.parquet(f"{path}/windows")
    if where is not None:
        windows = windows.where(where)
    windows = windows.withColumnRenamed(BLOCK, _INTO)
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.withColumn(_INTO, F.explode(F.sequence(F.col(BLOCK), F.col(BLOCK) + reach)))

    def assemble(stored: pd.DataFrame, wanted: pd.DataFrame) -> Iterator[pd.DataFrame]:
        stored = stored.sort_values(BLOCK)
        last = wanted[_INTO].iloc[0]
        parts = [np.asarray(x, dtype="float32").reshape(-1, width) for x in stored["x"]]
        before = sum(len(p) for p, b in zip(parts, stored[BLOCK], strict=True) if b < last)
        views = np.lib.stride_tricks.sliding_window_view(np.concatenate(parts), lookback, axis=0).transpose(0, 2, 1)
        starts = before + wanted[OFFSET].to_numpy() - (lookback - 1)
        if starts.min() < 0:
            raise ValueError("rows before a window are not in the store")
        meta = wanted.drop(columns=[_INTO, OFFSET])
        for i in range(0, len(meta), batch):
            yield function(meta.iloc[i : i + batch].reset_index(drop=True), views[starts[i : i + batch]])

    def groups(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame(columns=names)
        return pd.concat(assemble(stored, wanted), ignore_index=True)

    ship_package(spark)
    names = spark.createDataFrame([], schema).columns
    by = [*keys, _INTO]
    return rows.groupBy(*by).cogroup(windows.groupBy(*by)).applyInPandas(groups, schema)
