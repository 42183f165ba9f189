import math

import numpy as np
import pandas as pd
import pytest
from conftest import same, walk
from pyspark.sql import functions as F

from tidegauge.functions.calendar import calendar_columns
from tidegauge.functions.external import macro_names, macro_stages, route, sentiment_names, sentiment_stages
from tidegauge.functions.target import regression_target, ternary, threshold
from tidegauge.functions.technical import TECHNICAL, smoothed_columns, technical_stages
from tidegauge.operators.blocks import Blocked, SeriesSpec, index_rows
from tidegauge.plans.audit import leakage_audit, target_audit
from tidegauge.plans.features import FeatureConfig, feature_matrix, feature_names
from tidegauge.session import materialise

SMALL = SeriesSpec(block_rows=256)


def bank(bars, spec=SMALL, lag=0):
    b = Blocked.of(index_rows(bars, spec), spec, back=171)
    return smoothed_columns(materialise(b.run(technical_stages(b, lag)).home()), spec)


@pytest.fixture(scope="module")
def natural(bars):
    return bank(bars).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def wilder(x, n=14, min_periods=0):
    return x.ewm(alpha=1 / n, adjust=False, min_periods=min_periods).mean()


def expected(g):
    c, h, lo = g.close, g.high, g.low
    out, r = {}, np.log(c).diff()
    for k in (1, 4, 24, 168):
        out[f"logret_{k}"] = np.log(c).diff(k)
    for n in (24, 168):
        out[f"rv_{n}"] = r.rolling(n).std()
        out[f"zscore_{n}"] = (c - c.rolling(n).mean()) / c.rolling(n).std()
    gain, loss = c.diff().clip(lower=0), -c.diff().clip(upper=0)
    out["rsi_14"] = 100 - 100 / (1 + wilder(gain, 14, 14) / wilder(loss, 14, 14).replace(0, np.nan))
    out["macd_line"] = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    out["macd_signal"] = out["macd_line"].ewm(span=9, adjust=False).mean()
    out["macd_hist"] = out["macd_line"] - out["macd_signal"]
    out["roc_10"] = c.pct_change(10) * 100
    top, bottom = h.rolling(14).max(), lo.rolling(14).min()
    out["willr_14"] = -100 * (top - c) / (top - bottom)
    out["stoch_k"] = 100 * (c - bottom) / (top - bottom)
    out["stoch_d"] = out["stoch_k"].rolling(3).mean()
    tp = (h + lo + c) / 3
    dev = tp - tp.rolling(20).mean()
    out["cci_20"] = dev / (0.015 * dev.abs().rolling(20).mean())
    m, s = c.rolling(20).mean(), c.rolling(20).std()
    out["bb_upper"], out["bb_lower"] = m + 2 * s, m - 2 * s
    out["bb_pctb"], out["bb_bw"] = (c - m + 2 * s) / (4 * s), 4 * s / m
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    out["atr_14"] = wilder(tr, 14, 14)
    up, dn = h.diff(), -lo.diff()
    plus = 100 * wilder(up.where((up > dn) & (up > 0), 0.0)) / out["atr_14"]
    minus = 100 * wilder(dn.where((dn > up) & (dn > 0), 0.0)) / out["atr_14"]
    out["adx_14"] = wilder(100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan), 14, 14)
    return pd.DataFrame(out)


def test_bank_equals_pandas(natural, bars_pdf):
    want = pd.concat([expected(g) for _, g in bars_pdf.groupby("symbol")])
    for c in TECHNICAL:
        same(natural[c], want[c], 1e-8)


def test_first_valid_rows(natural):
    first = natural[natural.symbol == "B"].reset_index(drop=True)
    for column, row in {"rsi_14": 14, "cci_20": 38, "atr_14": 13, "adx_14": 26, "macd_line": 0, "rv_24": 24}.items():
        assert first[column].first_valid_index() == row, column


def test_bounds(natural):
    assert natural.rsi_14.dropna().between(0, 100).all()
    assert natural.willr_14.dropna().between(-100, 0).all()
    assert natural.stoch_k.dropna().between(0, 100).all()
    assert natural.bb_pctb.dropna().between(0, 1).mean() > 0.85


def test_shifted_inputs_equal_shifted_results(bars, natural):
    late = bank(bars, lag=1).toPandas().sort_values(["symbol", "ts"])
    for c in TECHNICAL:
        same(late[c], natural.groupby("symbol")[c].shift(1), 1e-9)


def test_no_losses_give_no_rsi(spark):
    pdf = walk(40)
    pdf["close"] = np.arange(40) + 100.0
    got = bank(materialise(spark.createDataFrame(pdf))).toPandas()
    assert got.rsi_14.isna().all()


def test_flat_bars_give_null_not_an_error(spark):
    pdf = walk(60)
    pdf[["open", "high", "low", "close"]] = 5.0
    got = bank(materialise(spark.createDataFrame(pdf))).toPandas()
    for c in ("willr_14", "stoch_k", "cci_20", "bb_pctb", "zscore_24", "adx_14"):
        assert got[c].isna().all(), c
    assert (got.rv_24.dropna() == 0.0).all()


def test_calendar(spark):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-07-07 14:00", "2024-12-31 23:00"])
    got = spark.createDataFrame(pd.DataFrame({"ts": ts})).withColumns(calendar_columns()).orderBy("ts").toPandas()
    same(got.hour_sin, np.sin(2 * np.pi * np.array([0, 14, 23]) / 24))
    same(got.dow_cos, np.cos(2 * np.pi * np.array([0, 6, 1]) / 7))
    same(got.month_sin, np.sin(2 * np.pi * np.array([0, 6, 11]) / 12))
    assert list(got.is_session_asia) == [1, 0, 1]
    assert list(got.is_session_eu) == [0, 1, 0]
    assert list(got.is_session_us) == [0, 1, 0]


def test_external_features(spark, bars, bars_pdf):
    values = np.random.default_rng(7).uniform(50, 60, len(bars_pdf))
    pdf = bars_pdf.assign(dxy=values, us10y_yield=values / 10, other=values, fear_greed=values)
    aligned = materialise(spark.createDataFrame(pdf))
    macro, sentiment = route(aligned.columns, ("symbol", "ts"))
    assert (macro, sentiment) == (["dxy", "us10y_yield", "other"], ["fear_greed"])
    b = Blocked.of(index_rows(aligned, SMALL), SMALL, back=170)
    got = b.run(macro_stages(b, macro), sentiment_stages(b, sentiment)).home().toPandas().sort_values(["symbol", "ts"])
    assert set(macro_names(macro) + sentiment_names(sentiment)) <= set(got.columns)

    def want(f):
        return pd.concat([f(g) for _, g in pdf.groupby("symbol")])

    same(got.dxy_logret_24, want(lambda g: np.log(g.dxy).diff(24).shift(1)))
    same(got.us10y_yield_d1, want(lambda g: g.us10y_yield.diff(1).shift(1)))
    same(got.other_level, want(lambda g: g.other.shift(1)))
    same(got.fear_greed_ma24, want(lambda g: g.fear_greed.rolling(24).mean().shift(1)))
    same(got.dxy_z168, want(lambda g: ((g.dxy - g.dxy.rolling(168).mean()) / g.dxy.rolling(168).std()).shift(1)), 1e-7)


def test_no_external_columns_add_nothing(bars):
    b = Blocked(bars, SMALL, back=170)
    assert route(bars.columns, ("symbol", "ts")) == ([], [])
    assert macro_stages(b, []) == [] and sentiment_stages(b, []) == []


def frame(spark, closes):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=len(closes), freq="h"), "close": closes})
    return index_rows(materialise(spark.createDataFrame(pdf)), SMALL)


def test_target_by_hand(spark):
    b = Blocked.of(frame(spark, [100.0, 101, 102, 103, 104, 105]), SMALL, back=0, ahead=2)
    got = b.run(regression_target(b, 2)).home().orderBy("ts").toPandas().y_reg_h2
    same(got, [math.log(102 / 100), math.log(103 / 101), math.log(104 / 102), math.log(105 / 103), np.nan, np.nan])


def test_threshold_ignores_the_current_bar(spark):
    def width(closes):
        b = Blocked.of(frame(spark, closes), SMALL, back=6)
        return b.run(threshold(b, 24, 3)).home().orderBy("ts").toPandas().y_clf_threshold

    calm = [100.0, 101, 102, 101, 103, 104, 105]
    same(width(calm), width([*calm[:-1], 200.0]))


def test_ternary_labels(spark):
    rows = [(2.0, 1.0), (-2.0, 1.0), (0.5, 1.0), (1.0, 1.0), (None, 1.0), (1.0, None), (0.1, 0.0)]
    got = spark.createDataFrame(rows, "y double, w double").select(ternary(F.col("y"), F.col("w")).alias("c")).collect()
    assert [r.c for r in got] == [1.0, -1.0, 0.0, 0.0, None, None, 1.0]


def test_matrix_and_audits(spark, bars):
    aligned = materialise(bars.withColumn("dxy", F.col("close") / 20).withColumn("fear_greed", F.col("close") % 100))
    table = materialise(feature_matrix(aligned, SMALL))
    counts = {r.symbol: r["count"] for r in table.groupBy("symbol").count().collect()}
    assert counts == {"A": 500, "B": 250}
    names = feature_names(table.columns, SMALL, FeatureConfig())
    assert len(names) == 23 + 3 + 3 + 9

    def build(rows, spec):
        return feature_matrix(rows, spec)

    audit = leakage_audit(aligned, build, names, SMALL, cuts=(0.7, 0.9)).toPandas()
    assert (audit.checked == 2).all()
    assert (audit.mismatches == 0).all()


def test_audits_catch_look_ahead(bars):
    def leaky(rows, spec):
        b = Blocked.of(index_rows(rows, spec), spec, back=1)
        return b.run([{"now": F.col("close") * 1.0, "late": b.lag("close", 1)}]).home()

    audit = leakage_audit(bars, leaky, ["now", "late"], SMALL, cuts=(0.5, 0.8)).toPandas().set_index(["symbol", "feature"])
    assert audit.loc[("A", "now"), "mismatches"] == 2
    assert audit.loc[("A", "late"), "mismatches"] == 0
    b = Blocked.of(index_rows(bars, SMALL), SMALL, back=0, ahead=24)
    good = materialise(b.run(regression_target(b, 24)).home())
    assert target_audit(good, SMALL, "y_reg_h24", 24).agg(F.sum("mismatches")).first()[0] == 0
    bad = good.withColumn("y_reg_h24", F.col("y_reg_h24") + 0.1)
    assert target_audit(bad, SMALL, "y_reg_h24", 24).agg(F.sum("mismatches")).first()[0] > 0
