import pandas as pd
from pyspark.sql import functions as F

from tidegauge.operators.blocks import SeriesSpec
from tidegauge.plans import runs
from tidegauge.sources.writers import read_scaler, read_split


def test_three_stages(spark, bars, tmp_path):
    day = pd.date_range("2023-12-01", periods=120, freq="D")
    ext = spark.createDataFrame(
        pd.DataFrame({"source": "vix", "value_date": day, "release_date": day + pd.Timedelta(days=1), "value": range(120)})
    ).withColumn("value", F.col("value").cast("double"))
    config = runs.BuildConfig(str(tmp_path), SeriesSpec(block_rows=256), embargo=5, folds=2)
    summary = runs.run_align(bars, ext, ["vix"], config).first()
    assert summary.rows == 1150 and summary.fill_pct == {"vix": 100.0} and summary.error == 0
    summary = runs.run_features(spark, config).first()
    assert summary.rows == 750 and summary.n_features == 23 + 3 + 9
    assert sum(b.n for b in summary.class_balance) == 750
    splits = {(r.symbol, r.split): (r.start_idx, r.end_idx) for r in runs.run_splits(spark, config).collect()}
    assert splits["A", "train"] == (0, 345) and splits["A", "test"] == (425, 500)
    train = read_split(spark, config.path("tabular"), "train")
    means = train.groupBy("symbol").agg(F.avg("macd_line").alias("m"), F.stddev_pop("macd_line").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in means)
    assert read_scaler(spark, config.path("scaler")).count() == 2 * 35
    val = read_split(spark, config.path("sequences"), "val").where("symbol = 'A'")
    # windows of validation rows reach back into train rows
    assert val.count() == 70
    shape = val.select(F.size("x").alias("l"), F.size(F.col("x")[0]).alias("f")).distinct().collect()
    assert [tuple(r) for r in shape] == [(168, 35)]
    assert spark.read.json(config.path("fold_summary")).count() == 2 * 2 * 2
