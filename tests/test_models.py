import random

import numpy as np
import pandas as pd
import pytest
from conftest import same, walk
from pyspark.sql import functions as F

from tidegauge.models import baselines as bl
from tidegauge.models import training as tr
from tidegauge.models.trees import BoostedTrees, RandomForest
from tidegauge.models.tuning import FOREST_SPACE, draw, tune
from tidegauge.operators.blocks import Blocked, SeriesSpec, index_rows
from tidegauge.operators.splits import chronological_split
from tidegauge.session import materialise

SMALL = SeriesSpec(block_rows=128)


def stepwise(phi, c, h, state):
    """Sum of h forecasts, one step at a time; state is newest first."""
    state, total = list(state), 0.0
    for _ in range(h):
        nxt = c + sum(p * s for p, s in zip(phi, state))
        total += nxt
        state = [nxt, *state]
    return total


def test_cumulative_weights():
    a, b = bl.cumulative_weights([0.5], 0.0, 24)
    same([a, b[0]], [0.0, 0.5 * (1 - 0.5**24) / 0.5])
    phi, c = [0.3, -0.2, 0.1], 0.02
    a, b = bl.cumulative_weights(phi, c, 24)
    state = [0.5, -1.0, 2.0]
    same([a + b @ state], [stepwise(phi, c, 24, state)])


@pytest.fixture(scope="module")
def ar_rows(spark):
    rng = np.random.default_rng(0)
    r = np.zeros(3000)
    for t in range(2, 3000):
        r[t] = 0.0005 + 0.5 * r[t - 1] - 0.3 * r[t - 2] + rng.normal(0, 0.01)
    pdf = walk(3000)
    pdf["close"] = 100 * np.exp(np.cumsum(r))
    return materialise(index_rows(materialise(spark.createDataFrame(pdf)), SMALL)), r


def test_ar_fit_recovers_the_process(ar_rows):
    rows, _ = ar_rows
    b = Blocked.of(rows, SMALL, back=7)
    fit = bl.fit_ar(bl.ar_moments(b.run(bl.lagged_returns(b, 5)).home(), ["symbol"]), ["symbol"]).first()
    assert fit.p >= 2
    assert abs(fit.phi[0] - 0.5) < 0.06 and abs(fit.phi[1] + 0.3) < 0.06
    a, w = bl.cumulative_weights(fit.phi, fit.intercept, 24)
    same([fit.a, *fit.b], [a, *w])


def test_ar_forecast_restarts_at_each_split(spark, ar_rows):
    rows, _ = ar_rows
    split = materialise(chronological_split(rows))
    a, w = bl.cumulative_weights([0.5, -0.3], 0.001, 24)
    coefs = spark.createDataFrame([("A", a, [float(x) for x in w])], "symbol string, a double, b array<double>")
    got = bl.attach_forecast(split, coefs, SMALL).toPandas().sort_values("ts")
    for _, part in got.groupby("split"):
        r = np.log(part.close).diff().fillna(0.0).to_numpy()
        want = [stepwise([0.5, -0.3], 0.001, 24, [r[i], r[i - 1] if i else 0.0]) for i in range(len(r))]
        same(part.y_pred, want)
        width = 0.5 * pd.Series(r).rolling(24).std().shift(1).to_numpy() * np.sqrt(24)
        label = np.where(np.isnan(width), 0, np.where(want > width, 1, np.where(want < -width, -1, 0)))
        assert list(part.y_label) == list(label)


def test_majority_prefers_the_smaller_label(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("A", -1.0), ("A", -1.0), ("A", None)], "symbol string, y double")
    out = bl.majority_class(df, "y").withColumns(bl.majority_columns()).first()
    assert (out.majority, out.y_pred, out.p_neg, out.p_neu, out.p_pos) == (-1.0, -1.0, 1.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (500, 4))
    y = x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.1, 500)
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2", "f3"])
    pdf["y_reg"], pdf["y_clf"] = y, np.select([y > 0.5, y < -0.5], [1.0, -1.0], 0.0)
    pdf["split"] = np.select([np.arange(500) < 350, np.arange(500) < 420], ["train", "val"], "test")
    pdf["symbol"], pdf["ts"] = "A", pd.date_range("2024-01-01", periods=500, freq="h")
    pdf["rn"], pdf["n_rows"] = np.arange(500), 500
    df = spark.createDataFrame(pdf)
    return materialise(df.withColumn("f3", F.when(F.col("rn") % 9 != 0, F.col("f3"))))


FEATURES = ["f0", "f1", "f2", "f3"]


def test_forest_regression_saves_and_loads(spark, signal, tmp_path):
    make = lambda: RandomForest(FEATURES, "y_reg", params={"numTrees": 10, "maxDepth": 6})
    with pytest.raises(RuntimeError):
        make().predict(signal)
    model = make()
    metrics = tr.train_and_evaluate(model, signal, str(tmp_path / "ledger"))
    mse = {r.split: r.value for r in metrics.where("metric = 'mse'").collect()}
    assert mse["test"] < 0.7 * signal.where("split = 'test'").agg(F.avg(F.col("y_reg") ** 2)).first()[0]
    assert model.importances().orderBy(F.desc("importance")).first().feature == "f0"
    ledger = tr.read_metrics(spark, str(tmp_path / "ledger"))
    run = ledger.first().run_id
    assert ledger.count() == 27
    stored = spark.read.parquet(str(tmp_path / "ledger" / "predictions"))
    assert stored.count() == 500 and {"model", "task", "split"} <= set(stored.columns)
    again = make().load(spark, str(tmp_path / "ledger" / "models" / run))
    a = again.predict(signal).orderBy("rn").toPandas().y_pred
    same(a, model.predict(signal).orderBy("rn").toPandas().y_pred)


def test_gaps_without_a_median_are_listed(spark):
    rows = [("A", "train", float(i % 3), None, 0.1 * i) for i in range(30)] + [("A", "train", None, None, 1.0), ("A", "test", None, 5.0, 1.0)]
    rows += [("B", "train", None, float(i), 0.2 * i) for i in range(30)] + [("C", "test", None, None, 1.0), ("C", "test", 1.0, None, 1.0)]
    frame = materialise(spark.createDataFrame(rows, "symbol string, split string, f double, g double, y double"))
    forest = RandomForest(["f", "g"], "y", params={"numTrees": 2, "maxDepth": 2})
    with pytest.raises(RuntimeError):
        forest.unfilled(frame)
    forest.fit(frame)
    got = {(r.symbol, r.feature): r.n for r in forest.unfilled(frame).collect()}
    assert got == {("A", "g"): 31, ("B", "f"): 30, ("C", "f"): 1, ("C", "g"): 2}
    assert forest.unfilled(frame.limit(0)).count() == 0


def test_forest_classes(signal):
    model = RandomForest(FEATURES, "y_clf", "classification", params={"numTrees": 10, "maxDepth": 6}).fit(signal)
    out = model.predict(signal.where("split = 'test'")).toPandas()
    assert set(out.y_pred) <= {-1.0, 0.0, 1.0}
    same(out.p_neg + out.p_neu + out.p_pos, np.ones(len(out)))
    assert (out.y_pred == out.y_clf).mean() > 0.6


def test_boosted_trees(signal):
    reg = BoostedTrees(FEATURES, "y_reg", params={"maxIter": 10, "maxDepth": 3, "stepSize": 0.3}).fit(signal)
    out = reg.predict(signal.where("split = 'test'")).toPandas()
    assert ((out.y_pred - out.y_reg) ** 2).mean() < 0.7 * (out.y_reg**2).mean()
    clf = BoostedTrees(FEATURES, "y_clf", "classification", params={"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}).fit(signal)
    out = clf.predict(signal.where("split = 'test'")).toPandas()
    same(out.p_neg + out.p_neu + out.p_pos, np.ones(len(out)))
    assert (out.y_pred == out.y_clf).mean() > 0.6
    with pytest.raises(ValueError):
        BoostedTrees(FEATURES, "y_reg", "ranking")


def test_search_is_seeded_and_picks_the_lowest_loss(signal):
    assert draw(FOREST_SPACE, random.Random(1)) == draw(FOREST_SPACE, random.Random(1))
    space = {"maxDepth": ("int", 1, 6, 1)}
    best, trials = tune(lambda p: RandomForest(FEATURES, "y_reg", params={"numTrees": 4, **p}), space, signal, 2, seed=3)
    rows = trials.orderBy("loss").collect()
    assert str(best["maxDepth"]) == rows[0].params["maxDepth"]


def test_learning_curve(signal):
    out = tr.learning_curve(
        lambda: RandomForest(FEATURES, "y_reg", params={"numTrees": 3, "maxDepth": 4}), signal.drop("split"), 2, (0.4, 1.0)
    ).orderBy("step").toPandas()
    assert list(out.share) == [0.4, 1.0]
    assert out[["train_mean", "val_mean"]].notna().all().all()
    assert (out.train_mean < out.val_mean).all()
