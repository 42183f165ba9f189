import numpy as np
import pandas as pd
import pytest
from conftest import same
from pyspark.sql import functions as F

from tidegauge.operators.blocks import Blocked, SeriesSpec, index_rows
from tidegauge.operators.ewm import FOLD_WIDTH, Ewm, affine_carries, ewm_means
from tidegauge.session import materialise

SMALL = SeriesSpec(block_rows=64)


def test_row_numbers(bars, bars_pdf):
    got = index_rows(bars, SMALL).toPandas().sort_values(["symbol", "ts"])
    for symbol, part in got.groupby("symbol"):
        assert list(part.rn) == list(range(len(part)))
        assert (part.n_rows == (bars_pdf.symbol == symbol).sum()).all()


def test_rolling_equals_pandas_across_block_borders(bars, bars_pdf):
    b = Blocked.of(index_rows(bars, SMALL), SMALL, back=100, ahead=70)
    got = b.run(
        [
            {
                "m": b.mean("close", 90),
                "s": b.std("close", 24),
                "lo": b.min("low", 14),
                "hi": b.max("high", 14),
                "z": b.zscore("close", 24),
                "lag": b.lag("close", 100),
                "lead": b.lead("close", 70),
                "part": b.mean_available("close", 30),
                "pct": b.pct_change("close", 10),
            }
        ]
    ).home().toPandas().sort_values(["symbol", "ts"])
    want = []
    for _, g in bars_pdf.groupby("symbol"):
        c = g.close
        want.append(
            pd.DataFrame(
                {
                    "m": c.rolling(90).mean(),
                    "s": c.rolling(24).std(),
                    "lo": g.low.rolling(14).min(),
                    "hi": g.high.rolling(14).max(),
                    "z": (c - c.rolling(24).mean()) / c.rolling(24).std(),
                    "lag": c.shift(100),
                    "lead": c.shift(-70),
                    "part": c.rolling(30, min_periods=1).mean(),
                    "pct": c.pct_change(10),
                }
            )
        )
    want = pd.concat(want)
    assert len(got) == len(bars_pdf)
    for c in want.columns:
        same(got[c], want[c], 1e-8)


def test_missing_values_void_the_frame(spark):
    x = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=7, freq="h"), "x": x})
    spec = SeriesSpec(block_rows=3)
    b = Blocked.of(index_rows(materialise(spark.createDataFrame(pdf)), spec), spec, back=2)
    got = b.run([{"m": b.mean("x", 3)}]).home().orderBy("ts").toPandas().m
    same(got, pd.Series(x, dtype="float64").rolling(3).mean())


def test_reach_is_checked(bars):
    b = Blocked(bars, SMALL, back=5)
    with pytest.raises(ValueError):
        b.lag("close", 6)
    with pytest.raises(ValueError):
        b.mean("close", 7)
    with pytest.raises(ValueError):
        b.lead("close", 1)


def test_a_hot_series_spreads_over_blocks(bars):
    b = Blocked.of(index_rows(bars, SMALL), SMALL, back=10)
    sizes = b.df.groupBy("symbol", "_blk").count().toPandas()
    assert sizes["count"].max() <= 64 + 10
    assert (sizes.symbol == "A").sum() == 11


@pytest.mark.parametrize("min_periods", [1, 14])
def test_exponential_mean_equals_pandas_with_gaps(spark, min_periods):
    rng = np.random.default_rng(3)
    frames = []
    for symbol, n in (("A", 900), ("B", 333)):
        x = pd.Series(100 + np.cumsum(rng.normal(0, 1, n)))
        x[rng.random(n) < 0.1] = np.nan
        x[:7] = np.nan
        x[200:330] = np.nan  # longer than a block
        frames.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x}))
    pdf = pd.concat(frames, ignore_index=True)
    rows = materialise(index_rows(materialise(spark.createDataFrame(pdf)), SMALL))
    rows = rows.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    wanted = {"w": Ewm("x", 1 / 14, min_periods), "s": Ewm.of_span("x", 9, min_periods)}
    got = ewm_means(rows, SMALL, wanted).toPandas().sort_values(["symbol", "ts"])
    group = pdf.groupby("symbol").x
    same(got.w, group.transform(lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=min_periods).mean()))
    same(got.s, group.transform(lambda x: x.ewm(span=9, adjust=False, min_periods=min_periods).mean()))


def test_carries_over_many_groups(spark):
    n = FOLD_WIDTH * 2 + 40
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0.5, 1, n), rng.normal(0, 1, n)
    pdf = pd.DataFrame({"k": "x", "i": range(n), "a": [[float(v)] for v in a], "b": [[float(v)] for v in b], "rest": 0})
    maps = materialise(spark.createDataFrame(pdf, "k string, i bigint, a array<double>, b array<double>, rest int"))
    got = affine_carries(maps, ["k"], "i", 1).orderBy("i").toPandas()
    want, e = [], 0.0
    for p, q in zip(a, b):
        want.append(e)
        e = p * e + q
    same([v[0] for v in got._carry], want)


@pytest.mark.parametrize("gaps", [False, True])
def test_means_of_any_span(spark, gaps):
    """Short spans get shorter scan blocks; more than one fold group at the small block size."""
    rng = np.random.default_rng(5)
    x = pd.Series(100 + np.cumsum(rng.normal(0, 1, 5000)))
    if gaps:
        x[rng.random(5000) < 0.2] = np.nan
        x[1000:1900] = np.nan
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=5000, freq="h"), "x": x})
    rows = materialise(index_rows(materialise(spark.createDataFrame(pdf)), SeriesSpec()))
    rows = rows.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    spans = (1, 2, 3, 5, 6, 12)
    got = ewm_means(rows, SeriesSpec(), {f"e{n}": Ewm.of_span("x", n) for n in spans}).toPandas().sort_values("ts")
    for n in spans:
        same(got[f"e{n}"], x.ewm(span=n, adjust=False).mean())
    with pytest.raises(ValueError):
        ewm_means(rows, SeriesSpec(), {"e": Ewm("x", 1.5)})
