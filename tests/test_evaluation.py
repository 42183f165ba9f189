import numpy as np
import pandas as pd
import pytest
from conftest import same
from pyspark.sql import functions as F

from tidegauge.evaluation import diagnostics as dg
from tidegauge.evaluation import metrics as mt
from tidegauge.evaluation import profile as pf
from tidegauge.operators.blocks import SeriesSpec, index_rows
from tidegauge.session import materialise

SMALL = SeriesSpec(block_rows=64)


def frame(spark, y_true, y_pred, **more):
    pdf = pd.DataFrame({"g": "x", "y_true": y_true, "y_pred": y_pred, **more})
    df = spark.createDataFrame(pdf)
    return materialise(df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y_true", "y_pred")}))


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(2)
    y = np.round(rng.normal(0, 1, 800), 1)
    p = np.round(0.4 * y + rng.normal(0, 1, 800), 1)
    y[::50] = np.nan
    return frame(spark, y, p), pd.DataFrame({"y": y, "p": p}).dropna()


def test_regression_metrics(noisy):
    df, pdf = noisy
    got = mt.regression_metrics(df, ["g"]).first().asDict()
    y, p = pdf.y, pdf.p
    far = y.abs() > 1e-12
    want = {
        "mse": ((y - p) ** 2).mean(),
        "rmse": np.sqrt(((y - p) ** 2).mean()),
        "mae": (y - p).abs().mean(),
        "mape": ((y - p)[far] / y[far]).abs().mean(),
        "r2": 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(),
        "directional_accuracy": (np.sign(y) == np.sign(p)).mean(),
        "pearson": y.corr(p),
        "spearman": y.rank().corr(p.rank()),
        "bias": (p - y).mean(),
    }
    for k, v in want.items():
        same([got[k]], [v])


def test_constant_prediction_has_no_correlation(spark):
    got = mt.regression_metrics(frame(spark, [1.0, 2.0, -3.0], [0.0, 0.0, 0.0]), ["g"]).first()
    assert got.pearson is None and got.spearman is None
    assert got.directional_accuracy == 0.0
    perfect = mt.regression_metrics(frame(spark, [1.0, 2.0, np.nan], [1.0, 2.0, 5.0]), ["g"]).first()
    assert (perfect.rmse, perfect.r2, perfect.directional_accuracy) == (0.0, 1.0, 1.0)


def test_classification_by_hand(spark):
    df = frame(spark, [-1.0, -1, 0, 0, 1, 1, np.nan], [-1.0, 0, 0, 0, 1, -1, 1])
    got = mt.classification_metrics(df, ["g"]).first()
    same([got.accuracy, got.precision_macro, got.recall_macro], [4 / 6, (1 / 2 + 2 / 3 + 1) / 3, (1 / 2 + 1 + 1 / 2) / 3])
    same([got.f1_macro], [(1 / 2 + 4 / 5 + 2 / 3) / 3])
    same([got.mcc], [(4 * 6 - (2 * 2 + 2 * 3 + 2 * 1)) / np.sqrt((36 - 14) * (36 - 12))])
    table = {r.y_true: (r.neg, r.neu, r.pos) for r in mt.confusion(df, ["g"]).collect()}
    assert table == {-1: (1, 1, 0), 0: (0, 2, 0), 1: (1, 0, 1)}
    report = {r.label: r for r in mt.class_report(df, ["g"]).collect()}
    same([report["weighted avg"].precision, report["macro avg"].support], [(2 * 0.5 + 2 * 2 / 3 + 2 * 1) / 6, 6])


def test_one_class_only(spark):
    got = mt.classification_metrics(frame(spark, [0.0, 0.0], [0.0, 0.0]), ["g"]).first()
    assert (got.accuracy, got.mcc) == (1.0, 0.0)
    same([got.f1_macro], [1 / 3])


def test_curves_against_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.choice([-1.0, 0.0, 1.0], 400)
    p = np.round(np.clip(0.5 + 0.2 * y + rng.normal(0, 0.3, 400), 0, 1), 2)  # many ties
    df = frame(spark, y, y, p_neg=1 - p, p_neu=0.5, p_pos=p)
    auc = {r.label: r.auc for r in mt.roc_auc(df, ["g"]).collect()}
    ap = {r.label: r for r in mt.average_precision(df, ["g"]).collect()}
    for label, score in ((-1, 1 - p), (0, np.full(400, 0.5)), (1, p)):
        hit = y == label
        pos, neg = score[hit], score[~hit]
        won = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        same([auc[label]], [won / (len(pos) * len(neg))])
        total, recall = 0.0, 0.0
        for t in sorted(set(score), reverse=True):
            taken = score >= t
            total += (hit[taken].sum() / hit.sum() - recall) * hit[taken].mean()
            recall = hit[taken].sum() / hit.sum()
        same([ap[label].average_precision, ap[label].prevalence], [total, hit.mean()])


def test_absent_class_is_skipped(spark):
    df = frame(spark, [0.0, 1.0, 1.0], [0.0, 1.0, 1.0], p_neg=0.1, p_neu=[0.6, 0.2, 0.3], p_pos=[0.3, 0.7, 0.6])
    assert {r.label for r in mt.roc_auc(df, ["g"]).collect()} == {0, 1}


def test_months_without_rows_stay(spark):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2024-01-05", "2024-01-06", "2024-04-01"]), "y_true": [1.0, 1.0, -1.0], "y_pred": [1.0, -1.0, -1.0]})
    got = dg.monthly_accuracy(spark.createDataFrame(pdf.assign(g="x")), ["g"]).orderBy("month_end").collect()
    assert [(str(r.month_end), r.dir_acc) for r in got] == [("2024-01-31", 0.5), ("2024-02-29", None), ("2024-03-31", None), ("2024-04-30", 1.0)]


def test_histogram_and_quadrants(noisy):
    df, pdf = noisy
    got = dg.residual_histogram(df, ["g"], 20).toPandas().sort_values("bin")
    r = pdf.y - pdf.p
    assert got.n.sum() == len(r)
    same([(got.density * (r.max() - r.min()) / 20).sum()], [1.0])
    same([got.mu.iloc[0], got.sigma.iloc[0]], [r.mean(), r.std(ddof=0)])
    q = dg.sign_quadrants(df, ["g"]).first()
    assert q.up_up + q.down_up + q.up_down + q.down_down == q.n == len(r)
    assert dg.density_grid(df, ["g"], 10).agg(F.sum("n")).first()[0] == len(r)


def test_probability_boxes(spark):
    p = np.array([0.1, 0.2, 0.3, 0.4, 0.99])
    df = frame(spark, [1.0] * 5, [1.0] * 5, p_neg=p, p_neu=p, p_pos=p)
    row = dg.probability_boxes(df, ["g"]).where("label = 1").first()
    same([row.q1, row["median"], row.q3, row.low, row.high], [0.2, 0.3, 0.4, 0.1, 0.4])


def test_residual_trend(spark):
    n = 400
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y_true": np.sin(np.arange(n)), "y_pred": 0.0})
    rows = index_rows(materialise(spark.createDataFrame(pdf)), SMALL)
    got = dg.residual_trend(rows, SMALL, 4).orderBy("ts").toPandas()
    want = pd.Series(np.sin(np.arange(n)))[::4]
    same(got.residual, want)
    same(got.trend, want.rolling(42, min_periods=1).mean())


def test_profile(bars, bars_pdf):
    groups = bars_pdf.groupby("symbol")
    m = pf.return_moments(bars, SMALL).orderBy("symbol").toPandas()
    for row, (_, g) in zip(m.itertuples(), groups):
        r = np.log(g.close).diff()
        same([row.mean_bp, row.std_bp, row.skew, row.kurt], [r.mean() * 1e4, r.std() * 1e4, r.skew(), r.kurtosis()], 1e-8)
    s = pf.series_summary(bars, SMALL).orderBy("symbol").toPandas()
    for row, (_, g) in zip(s.itertuples(), groups):
        same([row.n_rows, row.price_max], [len(g), g.high.max()])
        same([row.median_return_pct], [g.close.pct_change().abs().median() * 100])
        assert row.n_unique_days == g.ts.dt.date.nunique()
    acf = pf.autocorrelation(bars, SMALL, 5).toPandas().set_index(["symbol", "lag"])
    r = np.log(groups.get_group("A").close).diff()
    same([acf.loc[("A", 3), "acf_r"], acf.loc[("A", 5), "acf_r2"]], [r.autocorr(3), (r**2).autocorr(5)])


def test_feature_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (500, 3))
    x[:, 1] += x[:, 0] - 1e6
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(flat=3.3, symbol="A")
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(5)
    got = {(r.left, r.right): r.corr for r in pf.feature_correlation(df, ["a", "b", "c", "flat"]).collect()}
    want = pdf[["a", "b", "c"]].corr()
    for i, j in (("a", "b"), ("a", "c"), ("b", "c")):
        same([got[i, j]], [want.loc[i, j]], 1e-6)
    assert got["a", "flat"] is None


def test_binned_information(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 2000)
    df = spark.createDataFrame(pd.DataFrame({"copy": x, "noise": rng.normal(0, 1, 2000), "y": x}))
    got = {r.feature: r.mi for r in pf.binned_information(df, ["copy", "noise"], "y", 10).collect()}
    same([got["copy"]], [np.log(10)], 1e-3)
    assert got["noise"] < 0.05
