import numpy as np
import pandas as pd
import pytest
from conftest import same, walk
from pyspark.sql import functions as F

from tidegauge.operators import ordered as od
from tidegauge.operators import scaling as sc
from tidegauge.operators import sequences as sq
from tidegauge.operators import splits as sp
from tidegauge.operators import validate as va
from tidegauge.operators.blocks import SeriesSpec, index_rows
from tidegauge.session import materialise

SMALL = SeriesSpec(block_rows=64)


@pytest.fixture(scope="module")
def indexed(bars):
    return materialise(index_rows(bars, SMALL))


def test_split_bounds_and_embargo(spark):
    rows = spark.range(10_000).select(F.lit("A").alias("symbol"), F.col("id").alias("rn"), F.lit(10_000).alias("n_rows"))
    got = sp.chronological_split(rows).groupBy("split").agg(F.min("rn"), F.max("rn")).collect()
    assert {r[0]: (r[1], r[2]) for r in got if r[0]} == {"train": (0, 6975), "val": (7000, 8475), "test": (8500, 9999)}


def test_short_series_fail_or_are_listed(spark):
    rows = spark.range(50).select(F.lit("A").alias("symbol"), F.col("id").alias("rn"), F.lit(50).alias("n_rows"))
    for frame in (sp.chronological_split(rows), sp.walk_forward(rows)):
        with pytest.raises(Exception, match="series of 50 rows is too short"):
            frame.collect()
    assert sp.chronological_split(rows, short="exclude").where("split IS NOT NULL").count() == 0
    assert sp.walk_forward(rows, short="exclude").count() == 0
    assert [tuple(r) for r in sp.excluded_series(rows).collect()] == [("A", 50)]
    with pytest.raises(ValueError):
        sp.chronological_split(rows, short="drop")
    with pytest.raises(ValueError):
        sp.require_splittable(rows)
    with pytest.raises(ValueError):
        sp.chronological_split(rows, 0.8, 0.2, 0.2)
    with pytest.raises(ValueError):
        sp.chronological_split(rows, embargo=-1)


def test_walk_forward_grows_and_keeps_its_distance(spark):
    rows = spark.range(10_000).select(F.lit("A").alias("symbol"), F.col("id").alias("rn"), F.lit(10_000).alias("n_rows"))
    got = sp.walk_forward(rows).groupBy("fold", "role").agg(F.min("rn").alias("lo"), F.max("rn").alias("hi")).toPandas()
    train, val = (got[got.role == r].sort_values("fold") for r in ("train", "val"))
    assert list(train.hi + 1) == [3976, 5176, 6376, 7576, 8776]
    assert (val.lo.values - train.hi.values - 1 == 24).all()
    assert list(val.hi - val.lo + 1) == [1176] * 5
    with pytest.raises(ValueError):
        sp.walk_forward(rows, folds=0)


def test_cv_folds_match_the_usual_scheme(spark):
    n = 103
    rows = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("rn"), F.lit(n).alias("n_rows"))
    got = sp.cv_folds(rows, 3, [0.5, 1.0]).groupBy("fold", "train_rows", "role").agg(F.min("rn").alias("lo"), F.count("*").alias("c"))
    got = {(r.fold, r.train_rows, r.role): (r.lo, r.c) for r in got.collect()}
    # 103 rows, blocks of 25: tests start at 28, 53, 78; prefixes of the first 28 rows
    for fold, start in enumerate((28, 53, 78)):
        for size in (14, 28):
            assert got[fold, size, "val"] == (start, 25)
            assert got[fold, size, "train"] == (0, size)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"symbol": "A", "a": rng.normal(10, 2, 300), "b": rng.normal(0, 1, 300), "c": 7.0})
    pdf.loc[::10, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    return materialise(df), pdf


def test_scaler(table):
    df, pdf = table
    stats = sc.fit_scaler(df, ["a", "b", "c"])
    scale = {r.feature: r.scale for r in stats.collect()}
    assert scale["c"] == 1.0
    same([scale["b"]], [np.nanstd(pdf.b)])
    out = sc.apply_scaler(df, stats, ["a", "b", "c"]).toPandas()
    same([out.a.mean(), out.a.std(ddof=0), out.b.mean(), out.c.abs().max()], [0, 1, 0, 0])
    assert out.b.isna().sum() == 30
    assert sc.apply_scaler(df, stats, ["a", "b", "c"], fill=0.0).where("b = 0.0").count() == 30
    with pytest.raises(ValueError):
        sc.apply_scaler(df.drop("b"), stats, ["a", "b"])


def test_medians_and_labels(table):
    df, pdf = table
    med = sc.train_medians(df, ["a", "b"])
    got = {r.feature: r["median"] for r in med.collect()}
    same([got["a"], got["b"]], [pdf.a.median(), pdf.b.median()])
    same(sc.impute(df, med, ["a", "b"]).orderBy("a").toPandas().b, pdf.sort_values("a").b.fillna(pdf.b.median()))
    labels = df.sparkSession.createDataFrame([(-1.0,), (0.0,), (1.0,)], "y double")
    got = labels.select(sc.recode_label("y").alias("i")).select("i", sc.decode_label("i").alias("y")).collect()
    assert [tuple(r) for r in got] == [(0, -1.0), (1, 0.0), (2, 1.0)]


def test_ranks_and_quantiles_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    # one value holds a third of the rows
    v = np.where(rng.random(3000) < 0.34, 7.0, np.round(rng.normal(5, 3, 3000), 2))
    pdf = pd.DataFrame({"k": np.where(np.arange(3000) < 2500, "big", "small"), "v": v})
    df = spark.createDataFrame(pdf)
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    totals = od.running_totals(counts, ["k"], "v", ["n"], partitions=7).orderBy("k", "v").toPandas()
    want = pdf.groupby(["k", "v"]).size().groupby(level=0).cumsum().reset_index(name="c")
    same(totals.n_before + totals.n, want.c)
    ranks = od.average_ranks(df, ["k"], "v").toPandas().set_index(["k", "v"])["rank"]
    same(ranks.loc[list(zip(pdf.k, pdf.v))], pdf.groupby("k").v.rank())
    q = od.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).toPandas()
    for r in q.itertuples():
        assert abs(r.q - pdf[pdf.k == r.k].v.quantile(r.p)) < 1e-12


def test_sequence_count_and_content(indexed, bars_pdf):
    rows = indexed.withColumn("y", F.when(F.col("rn") < F.col("n_rows") - 24, F.col("close")))
    rows = rows.withColumn("gap", F.when(F.col("rn") % 5 != 0, F.col("rn").cast("double")))
    got = sq.sequence_windows(rows, SMALL, ["close", "gap"], ["y"], "y", 100)
    assert {r.symbol: r["count"] for r in got.groupBy("symbol").count().collect()} == {"A": 700 - 99 - 24, "B": 450 - 99 - 24}
    last = got.where("symbol = 'B'").orderBy(F.desc("ts")).first()
    closes = bars_pdf[bars_pdf.symbol == "B"].close.values
    assert len(last.x) == 100
    same([r[0] for r in last.x], closes[450 - 24 - 100 : 450 - 24], 1e-6)
    assert [r[1] for r in last.x][:2] == [326.0, 327.0] and last.x[4][1] is None
    with pytest.raises(ValueError):
        sq.sequence_windows(rows, SMALL, ["close"], [], "y", 0)


def test_context_windows(indexed):
    sizes = sq.context_windows(indexed, SMALL, 80).where("symbol = 'A'").orderBy("ts").select(F.size("context")).toPandas().iloc[:, 0]
    assert list(sizes) == [min(i + 1, 80) for i in range(700)]


def test_tabular_windows(indexed):
    out = sq.tabular_windows(indexed, SMALL, ["open", "close"], "close", 24, ["mean", "std"])
    assert set(out.columns) == {"symbol", "ts", "open", "close", "open_mean_24", "close_mean_24", "open_std_24", "close_std_24"}
    assert out.count() == 700 + 450 - 2 * 23
    assert out.dropna().count() == out.count()
    with pytest.raises(ValueError):
        sq.tabular_windows(indexed, SMALL, ["open"], "close", 24, ["mode"])


def codes(issues):
    return {(r.code, r.severity): r.n for r in issues.collect()}


def test_clean_bars_have_no_errors(spark):
    issues = va.validation_report(materialise(spark.createDataFrame(walk(24))), SMALL)
    assert codes(issues) == {("VOLUME_ALL_ZERO", "info"): 1}
    va.raise_if_errors(issues)
    assert va.issue_summary(issues).first().asDict() == {"info": 1, "warning": 0, "error": 0}


def test_each_fault_is_found(spark):
    pdf = walk(24)
    pdf.loc[3, "high"] = pdf.loc[3, "low"] - 1
    pdf.loc[4, "close"] = np.nan
    pdf = pd.concat([pdf, pdf.iloc[[10]]], ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    issues = va.validation_report(materialise(df), SMALL)
    got = codes(issues)
    assert got[("DUPLICATES", "error")] == 2
    assert got[("OHLC_HIGH_INCONSISTENT", "error")] == 1
    assert got[("NAN_VALUES", "warning")] == 1
    assert issues.where("code = 'NAN_VALUES'").first().details == {"close": "1"}
    with pytest.raises(ValueError, match="DUPLICATES"):
        va.raise_if_errors(issues)


def test_order_over_ingest_runs(spark):
    ts = pd.date_range("2024-01-01", periods=20, freq="h").to_list()
    ts[5], ts[6] = ts[6], ts[5]
    ts[7], ts[8] = ts[8], ts[7]  # across the border of runs of 8
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "seq": range(20), "ts": ts}))
    for span in (8, 1000):
        assert va.order_violations(df, "seq", span=span).first().n == 2
    assert codes(va.check_order(df, "seq")) == {("INDEX_NOT_MONOTONIC", "error"): 2}
    assert codes(va.check_order(df.withColumn("ts", F.col("ts").cast("string")), "seq")) == {("INDEX_NOT_DATETIME", "error"): 1}


def gaps(spark, *stamps):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(list(stamps))})
    return va.check_gaps(materialise(spark.createDataFrame(pdf)), SMALL)


def test_gap_classes(spark):
    assert codes(gaps(spark, "2024-01-05 22:00", "2024-01-07 22:00", "2024-01-07 23:00")) == {("WEEKEND_GAPS", "info"): 1}
    found = gaps(spark, "2024-01-09 10:00", "2024-01-09 18:00")
    assert codes(found) == {("WEEKDAY_GAPS", "warning"): 1}
    assert '"gap_hours":8.0' in found.first().details["examples"]
    # a weekend longer than 60 hours is no normal weekend
    assert codes(gaps(spark, "2024-01-05 05:00", "2024-01-08 05:00")) == {("WEEKDAY_GAPS", "warning"): 1}
