"""Lag and range sums, perturbation audit, baselines as models, storage and ledger."""

import numpy as np
import pandas as pd
import pytest
from conftest import same, walk
from pyspark.sql import functions as F

from tidegauge.evaluation import profile as pf
from tidegauge.models import baselines as bl
from tidegauge.models import training as tr
from tidegauge.models.base import load_model, read_description
from tidegauge.models.naive import AutoRegression, MajorityClass, ZeroForecast
from tidegauge.models.trees import BoostedTrees, RandomForest
from tidegauge.operators import splits as sp
from tidegauge.operators.blocks import ROW, ROWS, Blocked, SeriesSpec, index_rows
from tidegauge.operators.lagsums import SUMS, lag_products, range_sums, segment_sums
from tidegauge.plans.audit import perturbation_audit
from tidegauge.session import materialise

SMALL = SeriesSpec(block_rows=64)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.2, 1, 333)
    x[::17] = np.nan
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=333, freq="h"), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return materialise(index_rows(materialise(df), SMALL)), x


@pytest.mark.parametrize("lags", [1, 7, 63, 80])
def test_lag_products_cross_block_borders(numbers, lags):
    rows, x = numbers
    got = lag_products(Blocked.of(rows, SMALL, back=lags), ["x"], lags).groupBy("lag").agg(*[F.sum(s).alias(s) for s in SUMS])
    got = got.toPandas().set_index("lag")
    assert len(got) == lags
    for k in {1, (lags + 1) // 2, lags}:
        a, b = x[k:], x[:-k]
        ok = ~np.isnan(a) & ~np.isnan(b)
        a, b = a[ok], b[ok]
        same(got.loc[k, list(SUMS)].to_numpy(), [len(a), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()])


def test_lag_products_need_their_halo(numbers):
    with pytest.raises(ValueError):
        lag_products(Blocked.of(numbers[0], SMALL, back=3), ["x"], 4)


def test_autocorrelation_of_a_constant_return_is_missing(spark):
    pdf = walk(200)
    pdf["close"] = 100 * np.exp(0.01 * np.arange(200))
    acf = pf.autocorrelation(materialise(spark.createDataFrame(pdf)), SMALL, 4).toPandas()
    assert len(acf) == 4 and acf[["acf_r", "acf_r2"]].isna().all().all()
    short = pf.autocorrelation(materialise(spark.createDataFrame(pdf[:3])), SMALL, 4)
    assert [r.lag for r in short.collect()] == [1]  # two returns make one pair


def test_range_sums_of_overlapping_and_empty_ranges(numbers):
    rows, x = numbers
    n = F.col(ROWS)
    ranges = {"all": (F.lit(0), n), "mid": (F.lit(30), n - 100), "late": (n - 5, n), "block": (F.lit(64), F.lit(128)), "none": (n, n + 9)}
    sums = {"s": F.sum("x"), "q": F.sum(F.col("x") * F.col("x"))}
    segments = segment_sums(rows.where("x is not null"), SMALL, sums, ranges)
    got = range_sums(segments, SMALL, list(sums), ranges).toPandas().set_index("range")
    assert set(got.index) == {"all", "mid", "late", "block"}
    for name, part in {"all": x, "mid": x[30:233], "late": x[-5:], "block": x[64:128]}.items():
        same(got.loc[name, ["s", "q"]].to_numpy(), [np.nansum(part), np.nansum(part**2)])


def test_ar_fits_of_folds_equal_fits_of_their_rows(spark):
    rows = materialise(index_rows(materialise(spark.createDataFrame(pd.concat([walk(700, "A", 1), walk(500, "B", 2)]))), SMALL))
    b = Blocked.of(sp.foldable(rows), SMALL, back=7)
    lagged = materialise(b.run(bl.lagged_returns(b, 5)).home())
    got = bl.fit_ar(bl.ar_range_moments(lagged, SMALL, sp.train_ranges()), ["symbol", "fold"])
    parts = sp.walk_forward(lagged).where("role = 'train'")
    want = bl.fit_ar(bl.ar_moments(parts, ["symbol", "fold"]), ["symbol", "fold"])
    got, want = (t.orderBy("symbol", "fold").toPandas() for t in (got, want))
    assert len(got) == 10 and list(got.p) == list(want.p)
    same(np.concatenate(got.phi.tolist()), np.concatenate(want.phi.tolist()), 1e-7)
    with pytest.raises(Exception, match="too short"):
        sp.foldable(rows, folds=40).count()
    assert sp.foldable(rows, folds=40, short="exclude").count() == 0


def _audit(spark, build, features):
    bars = materialise(spark.createDataFrame(pd.concat([walk(300, "A", 1, gaps=True), walk(150, "B", 2)])))
    got = perturbation_audit(bars, build, features, SMALL, cuts=(0.21, 0.5, 0.99))
    return {(r.symbol, r.feature): (r.checked, r.mismatches) for r in got.collect()}


def test_perturbation_audit_passes_and_finds(spark):
    def build(bars, spec):
        b = Blocked.of(index_rows(bars, spec), spec, back=25, ahead=2)
        cols = {"past": b.lag("close", 1), "ahead": b.lead("high", 2), "own": F.col("volume")}
        return b.run([cols, {"mean": b.mean("past", 24)}]).home()

    got = _audit(spark, build, ["past", "mean", "own", "ahead"])
    checked = {"A": 63 + 1 + 150 + 1 + 297 + 1, "B": 31 + 1 + 75 + 1 + 148 + 1}
    for symbol, rows in checked.items():
        assert got[symbol, "past"] == got[symbol, "mean"] == (rows, 0)
        # volume is zero and stays zero under a factor, so this copy tells nothing
        assert got[symbol, "own"] == (rows, 0)
    assert got["A", "ahead"] == (checked["A"], 9)
    # the last cut of B is row 148 of 150: row 148 has no bar two rows on
    assert got["B", "ahead"] == (checked["B"], 8)


@pytest.fixture(scope="module")
def split_rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.concat([walk(600, "A", 1), walk(400, "B", 2)])
    pdf["f0"] = rng.normal(0, 1, len(pdf))
    pdf["y_reg_h24"] = 0.5 * pdf.f0 + rng.normal(0, 0.1, len(pdf))
    pdf["y_clf_h24"] = np.where(pdf.f0 > 0.3, 1.0, np.where(pdf.f0 < -1.0, -1.0, 0.0))
    rows = index_rows(materialise(spark.createDataFrame(pdf)), SMALL)
    return materialise(sp.chronological_split(rows))


MODELS = {
    "zero": lambda: ZeroForecast(),
    "majority": lambda: MajorityClass(),
    "ar": lambda: AutoRegression(params={"orders": (1, 2), "horizon": 6, "block_rows": 64}),
    "ar_classes": lambda: AutoRegression(target="y_clf_h24", task="classification"),
    "forest": lambda: RandomForest(["f0"], "y_reg_h24", params={"numTrees": 3, "maxDepth": 3}, seed=7),
    "forest_classes": lambda: RandomForest(["f0"], "y_clf_h24", "classification", params={"numTrees": 3, "maxDepth": 3}),
    "boosted": lambda: BoostedTrees(["f0"], "y_reg_h24", params={"maxIter": 2, "maxDepth": 2}),
}


@pytest.mark.parametrize("kind", MODELS)
def test_a_stored_model_needs_only_its_folder(spark, split_rows, tmp_path, kind):
    model, path = MODELS[kind](), str(tmp_path / "model")
    rows = split_rows.where("split is not null")
    if kind != "zero":
        with pytest.raises(RuntimeError):
            model.predict(rows)
    model.fit(split_rows).save(path)
    again = load_model(spark, path)
    assert type(again) is type(model) and again.task == model.task and again.target == model.target
    assert list(again.features) == list(model.features) and again.seed == model.seed
    order = ["symbol", "ts"]
    a, b = (m.predict(rows).orderBy(*order).toPandas() for m in (model, again))
    assert list(a.columns) == [*rows.columns, *model.outputs()]
    for c in model.outputs():
        same(a[c], b[c])
    assert len(a) == rows.count()


def test_loading_into_another_kind_fails(spark, split_rows, tmp_path):
    path = str(tmp_path / "m")
    MajorityClass().fit(split_rows).save(path)
    assert read_description(spark, path)["kind"] == "majority"
    with pytest.raises(ValueError, match="holds a majority"):
        ZeroForecast().load(spark, path)
    with pytest.raises(ValueError):
        ZeroForecast(task="classification")


def test_majority_is_per_series_and_unknown_series_get_null(spark, split_rows):
    model = MajorityClass().fit(split_rows)
    train = split_rows.where("split = 'train'").toPandas()
    want = {s: p.y_clf_h24.mode().iloc[0] for s, p in train.groupby("symbol")}
    out = model.predict(split_rows.withColumn("symbol", F.when(F.col("symbol") == "A", "A").otherwise("Z"))).toPandas()
    assert set(out[out.symbol == "A"].y_pred) == {want["A"]}
    assert out[out.symbol == "Z"].y_pred.isna().all() and len(out) == 1000


def test_ledger_shows_finished_runs_only(spark, split_rows, tmp_path):
    path = str(tmp_path / "ledger")
    for kind in ("zero", "ar"):
        tr.train_and_evaluate(MODELS[kind](), split_rows, path, {"note": kind})
    runs = {r.model: r for r in tr.read_runs(spark, path).collect()}
    sizes = {r["split"]: r["count"] for r in split_rows.where("split is not null").groupBy("split").count().collect()}
    for r in runs.values():
        assert (r.n_train, r.n_val, r.n_test) == (sizes["train"], sizes["val"], sizes["test"])
        assert r.fit_seconds >= 0 and load_model(spark, r.artifacts["model"]).name == r.model
    assert runs["naive_zero"].n_features == 0 and runs["autoregression"].n_features == 1
    assert runs["autoregression"].params["note"] == "ar"
    # a run that died before its row in runs was written
    tr.read_metrics(spark, path).limit(1).withColumn("run_id", F.lit("dead")).write.mode("append").parquet(f"{path}/metrics")
    assert tr.read_metrics(spark, path).where("run_id = 'dead'").count() == 0
    assert tr.read_predictions(spark, path).count() == 2 * sum(sizes.values())
    rmse = {r.model: r.value for r in tr.read_metrics(spark, path).where("metric = 'rmse' and split = 'val'").collect()}
    assert tr.best_run(spark, path, "rmse").name == min(rmse, key=rmse.get)
    with pytest.raises(ValueError):
        tr.best_run(spark, path, "f1_macro", task="classification")
