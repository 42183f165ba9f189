"""Windows by reference against windows cut from the rows."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from conftest import same, walk
from pyspark.sql import functions as F

from tidegauge.operators.blocks import SeriesSpec, index_rows
from tidegauge.operators.window_store import map_windows, read_layout, write_window_store
from tidegauge.session import materialise

SMALL = SeriesSpec(block_rows=32)
SCHEMA = "symbol string, ts timestamp, first double, last double, total double, gaps long, n long"


@pytest.fixture(scope="module")
def summary():
    # a closure, because workers cannot import the tests
    def digest(meta, x):
        return meta[["symbol", "ts"]].assign(
            first=x[:, 0, 0].astype(float), last=x[:, -1, -1].astype(float),
            total=np.nansum(x.astype(float), axis=(1, 2)), gaps=np.isnan(x).sum((1, 2)), n=len(meta),
        )

    return digest


@pytest.fixture(scope="module")
def rows(spark):
    pdf = pd.concat([walk(150, "A", 1, gaps=True), walk(40, "B", 2), walk(5, "C", 3)])
    pdf["y"] = np.where(np.arange(len(pdf)) % 11 == 0, np.nan, 1.0)
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    df = df.withColumn("low", F.when(F.hour("ts") != 3, F.col("low")))
    return materialise(index_rows(materialise(df), SMALL))


def expected(rows, lookback):
    out = {}
    for symbol, part in rows.orderBy("symbol", "ts").toPandas().groupby("symbol"):
        x = part[["close", "low"]].to_numpy().astype("float32")
        for i in range(lookback - 1, len(part)):
            if not np.isnan(part.y.iloc[i]):
                w = x[i - lookback + 1 : i + 1].astype(float)
                out[symbol, part.ts.iloc[i]] = (w[0, 0], w[-1, -1], np.nansum(w), np.isnan(w).sum())
    return out


@pytest.mark.parametrize("lookback", [1, 24, 32, 33, 100])
def test_windows_cross_block_borders(spark, rows, summary, tmp_path, lookback):
    path = write_window_store(rows, SMALL, ["close", "low"], ["y"], "y", str(tmp_path / "w"), lookback)
    got = map_windows(spark, path, summary, SCHEMA, batch=10).toPandas()
    want = expected(rows, lookback)
    assert len(got) == len(want) and got.n.max() <= 10
    for r in got.itertuples():
        same([r.first, r.last, r.total, r.gaps], want[r.symbol, r.ts], 1e-6)
    assert read_layout(spark, path)["features"] == ["close", "low"]


def test_a_part_of_the_windows_and_none(spark, rows, summary, tmp_path):
    path = write_window_store(rows, SMALL, ["close", "low"], ["y"], "y", str(tmp_path / "w"), 24)
    got = map_windows(spark, path, summary, SCHEMA, where="symbol = 'B'").toPandas()
    assert set(got.symbol) == {"B"} and len(got) == sum(s == "B" for s, _ in expected(rows, 24))
    empty = write_window_store(rows.where("false"), SMALL, ["close", "low"], ["y"], "y", str(tmp_path / "e"), 24)
    assert map_windows(spark, empty, summary, SCHEMA).count() == 0
    with pytest.raises(ValueError):
        write_window_store(rows, SMALL, ["close"], ["y"], "y", str(tmp_path / "x"), 0)


def test_stored_bytes_do_not_grow_with_the_lookback(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = [f"f{i}" for i in range(20)]
    pdf = pd.DataFrame(rng.normal(0, 1, (3000, 20)).astype("float32"), columns=names)
    pdf["symbol"], pdf["ts"], pdf["y"] = "A", pd.date_range("2024-01-01", periods=3000, freq="h"), 0.0
    rows = materialise(index_rows(materialise(spark.createDataFrame(pdf)), SeriesSpec()))
    path = write_window_store(rows, SeriesSpec(), names, ["y"], "y", str(tmp_path / "w"), 168)
    size = sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))
    assert size < 1.2 * 3000 * 20 * 4
