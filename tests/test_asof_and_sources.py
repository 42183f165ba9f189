import json

import numpy as np
import pandas as pd
import pytest
from conftest import same
from pyspark.sql import functions as F

from tidegauge.operators.asof import align_grid, align_intervals, align_sources
from tidegauge.operators.bars import arrival_order, build_bars
from tidegauge.operators.blocks import SeriesSpec
from tidegauge.sources import readers as rd
from tidegauge.sources import writers as wr

SPEC = SeriesSpec(block_rows=48)


def external(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["source", "value_date", "release_date", "value"]))


def grid(spark, n, start="2024-01-01"):
    return spark.createDataFrame(pd.DataFrame({"ts": pd.date_range(start, periods=n, freq="h")}))


@pytest.mark.parametrize("seed", [42, 123, 456])
def test_aligned_value_is_the_latest_release(spark, seed):
    rng = np.random.default_rng(seed)
    hours = pd.date_range("2024-01-01", periods=720, freq="h")
    picked = np.sort(rng.choice(720, 60, replace=False))
    ext = pd.DataFrame({"value_date": hours[picked], "value": rng.normal(size=60)})
    ext["release_date"] = ext.value_date + pd.Timedelta(days=2)
    got = align_grid(grid(spark, 720), external(spark, ext.assign(source="s")[["source", "value_date", "release_date", "value"]]), ["s"], SPEC)
    want = pd.merge_asof(pd.DataFrame({"ts": hours}), ext, left_on="ts", right_on="release_date")
    got = got.toPandas().sort_values("ts")
    same(got.s, want.value)
    long = align_intervals(grid(spark, 720), external(spark, ext.assign(source="s")[["source", "value_date", "release_date", "value"]]), SPEC)
    same(long.toPandas().sort_values("ts").value, want.value.dropna())


def test_release_and_not_value_date_counts(spark):
    ext = external(spark, [("s", pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-15"), 42.0)])
    got = align_grid(grid(spark, 20 * 24), ext, ["s"], SPEC).toPandas().sort_values("ts")
    assert got[got.ts < "2024-01-15"].s.isna().all()
    assert (got[got.ts >= "2024-01-15"].s == 42.0).all()


def test_ties_revisions_and_released_gaps(spark):
    day = pd.Timestamp("2024-01-02")
    rows = [
        ("s", pd.Timestamp("2023-12-01"), day, 1.0),
        ("s", pd.Timestamp("2023-12-31"), day, 2.0),
        ("s", pd.Timestamp("2024-01-01"), day + pd.Timedelta(hours=5), None),
    ]
    got = align_grid(grid(spark, 48), external(spark, rows), ["s"], SPEC).toPandas().sort_values("ts").s.tolist()
    assert got[24:29] == [2.0] * 5
    assert np.isnan(got[29:]).all()


def test_every_bar_is_kept_and_sources_are_columns(spark, bars):
    ext = external(
        spark,
        [
            ("a", pd.Timestamp("2023-12-30"), pd.Timestamp("2023-12-31"), 1.0),
            ("b", pd.Timestamp("2024-01-03"), pd.Timestamp("2024-01-04"), 2.0),
        ],
    )
    out = align_sources(bars, ext, ["a", "b"], SPEC)
    assert out.count() == bars.count()
    assert out.where("a IS NULL").count() == 0
    assert out.where("b IS NULL").count() == bars.where("ts < '2024-01-04'").count()


def test_externals_without_release_dates_are_refused(spark):
    bad = spark.createDataFrame([("s", 1.0)], "source string, value double")
    with pytest.raises(ValueError):
        align_grid(grid(spark, 3), bad, ["s"], SPEC)


def test_bars_use_arrival_order(spark):
    t = pd.Timestamp("2024-01-01 10:00")
    ticks = pd.DataFrame(
        {
            "k": "A",
            "t": [t + pd.Timedelta(minutes=m) for m in (1, 1, 30, 59, 61)],
            "p": [5.0, 4.0, 9.0, 6.0, 7.0],
            "major": [2, 1, 3, 4, 5],
            "minor": [0, 0, 0, 0, 0],
        }
    )
    order = arrival_order((F.col("major"), 19), (F.col("minor"), 10))
    got = build_bars(spark.createDataFrame(ticks), key="k", ts="t", price="p", order=order).orderBy("ts").collect()
    assert [tuple(r)[2:] for r in got] == [(4.0, 9.0, 4.0, 6.0, 4.0, 4), (7.0, 7.0, 7.0, 7.0, 1.0, 1)]


def test_bar_csv(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("Datetime,Open,High,Low,Close,Volume\n2024-01-01 05:00:00,1,3,0.5,2,0\n2024-07-01 05:00:00,1,3,0.5,2,0\n")
    got = rd.read_bars_csv(spark, str(path), "X", "America/New_York").orderBy("ts").toPandas()
    assert [str(t) for t in got.ts] == ["2024-01-01 10:00:00", "2024-07-01 09:00:00"]
    assert got.dtypes["volume"] == "float64"
    path.write_text("Datetime,Open\n2024-01-01,1\n")
    with pytest.raises(ValueError):
        rd.read_bars_csv(spark, str(path), "X")


def test_unreadable_time_fails(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("Datetime,Open,High,Low,Close,Volume\nnot a time,1,3,0.5,2,0\n")
    with pytest.raises(Exception, match="(?i)cast|parse|timestamp"):
        rd.read_bars_csv(spark, str(path), "X").collect()


def test_csv_times_do_not_depend_on_the_session_zone(spark, tmp_path):
    path = tmp_path / "bars.csv"
    times = ["2024-01-01 05:00:00", "2024-01-02", "2024-01-01T05:00:00Z", "2024-01-01 05:00:00+02:00"]
    path.write_text("Datetime,Open,High,Low,Close,Volume\n" + "".join(f"{t},1,1,1,1,1\n" for t in times))
    want = [1704103200, 1704171600, 1704085200, 1704078000]
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for bars in (rd.read_bars_csv(spark, str(path), "X", "America/New_York"), rd.sift_bars_csv(spark, str(path), "X", "America/New_York")[0]):
                assert sorted(r[0] for r in bars.select(F.unix_seconds("ts")).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sifted_csv_keeps_every_line(spark, tmp_path):
    lines = {
        "2024-01-01 00:00:00,1,3,0.5,2,0": None,
        "2024-01-02 00:00:00,1,3,0.5,2,": None,
        "2024-01-03 00:00:00,1,3": "wrong number of fields",
        "2024-01-04 00:00:00,1,3,0.5,2,0,9,9": "wrong number of fields",
        ",1,3,0.5,2,0": "no time",
        "yesterday,1,3,0.5,2,0": "unreadable time",
        "2024-01-05 00:00:00,1,high,0.5,2,0": "unreadable high",
        "2024-01-06 00:00:00,x,y,0.5,2,0": "unreadable open",
    }
    for name in ("A", "B"):
        (tmp_path / f"symbol={name}").mkdir()
        (tmp_path / f"symbol={name}" / "f.csv").write_text("\n".join(["Datetime,Open,High,Low,Close,Volume", *lines]) + "\n")
    bars, rejected = rd.sift_bars_csv(spark, str(tmp_path), F.regexp_extract("_metadata.file_path", r"symbol=([^/]+)", 1))
    got = rejected.collect()
    assert {(r.symbol, r.record): r.reason for r in got} == {(s, t): w for s in "AB" for t, w in lines.items() if w}
    assert len(got) == 12 and all(r.file.endswith("f.csv") for r in got)
    kept = bars.orderBy("symbol", "ts").collect()
    assert [r.symbol for r in kept] == ["A", "A", "B", "B"] and [r.volume for r in kept] == [0.0, None] * 2
    (tmp_path / "symbol=B" / "f.csv").write_text("Datetime,Open,High,Close,Low,Volume\n2024-01-01,1,1,1,1,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        rd.sift_bars_csv(spark, str(tmp_path), "X")[0].collect()


def test_external_folder(spark, tmp_path):
    day = pd.Timestamp("2024-01-01")
    one = pd.DataFrame({"value_date": [day], "release_date": [day], "value": [1.0]})
    one.to_parquet(tmp_path / "macro_dxy.parquet")
    one.assign(keyword="gold").to_parquet(tmp_path / "sentiment_google_trends.parquet")
    one.to_parquet(tmp_path / "other.parquet")
    found = rd.read_external_folder(spark, str(tmp_path))
    assert {r.source for r in found.collect()} == {"dxy", "google_trends:gold"}
    assert {str(r.value_date) for r in found.collect()} == {"2024-01-01 00:00:00"}
    # rows of both sessions meet in one plan
    assert found.join(spark.createDataFrame([("dxy",)], "source string"), "source").count() == 1
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == "false"


def test_external_round_trip(spark, tmp_path):
    rows = [(s, f"2024-01-0{d}", f"2024-01-0{d + 1}", float(d)) for s in ("vix", "fear_greed") for d in range(1, 5)]
    ext = spark.createDataFrame(rows, "source string, v string, r string, value double")
    ext = ext.select("source", F.to_timestamp("v").alias("value_date"), F.to_timestamp("r").alias("release_date"), "value")
    path = wr.write_external(ext, str(tmp_path / "ext"))
    got = rd.read_external_table(spark, path)
    assert got.columns == ext.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, ext.collect()))


def test_sentiment_files_and_fallback(spark, tmp_path, caplog):
    csv, js = tmp_path / "fg.csv", tmp_path / "fg.json"
    csv.write_text("Date,Score\n2024-01-01,55\n")
    js.write_text(json.dumps({"data": [{"timestamp": "1704067200", "value": "40"}]}))
    assert rd.read_sentiment_csv(spark, str(csv)).first().value == 55.0
    row = rd.read_sentiment_json(spark, str(js)).first()
    assert (str(row.value_date), row.value) == ("2024-01-01 00:00:00", 40.0)
    tries = [(rd.read_sentiment_csv, str(tmp_path / "absent.csv")), (rd.read_sentiment_json, str(js))]
    assert rd.first_available(spark, tries).first().value == 40.0
    assert "absent.csv could not be read" in caplog.text
    empty = rd.first_available(spark, tries[:1])
    assert empty.columns == ["value_date", "release_date", "value"] and empty.count() == 0
    csv.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        rd.read_sentiment_csv(spark, str(csv))


def test_keywords_and_release_dates(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0, None, True)], "date string, gold double, silver double, isPartial boolean")
    got = rd.keywords_long(wide, ["gold", "silver"]).collect()
    assert [(r.keyword, r.value) for r in got] == [("gold", 1.0)]
    ext = spark.createDataFrame(
        pd.DataFrame({"source": ["a", "b", "c"], "value_date": pd.Timestamp("2024-01-31"), "value": 1.0})
    )
    known = ext.where("source <> 'c'")
    got = rd.stamp_release(known, {"a": "daily", "b": "monthly"}, {"b": 45}).orderBy("source").toPandas()
    assert str(got.release_date[0].date()) == "2024-02-01"
    assert str(got.release_date[1].date()) == "2024-03-16"
    with pytest.raises(Exception, match="no release lag is known for source c"):
        rd.stamp_release(ext, {"a": "daily", "b": "monthly"}).collect()
    with pytest.raises(ValueError):
        rd.stamp_release(ext, {"a": "hourly"})


def test_tables_round_trip(spark, tmp_path, bars):
    path = wr.write_table(bars.withColumn("split", F.when(F.col("symbol") == "A", "train").otherwise("val")), str(tmp_path / "t"), ["split"])
    assert wr.read_split(spark, path, "train").count() == 700
    scaler = spark.createDataFrame([("A", "f", 1.0, 2.0)], "symbol string, feature string, mean double, scale double")
    wr.write_scaler(scaler, str(tmp_path / "s"))
    assert wr.read_scaler(spark, str(tmp_path / "s")).first() == scaler.first()
    wr.write_summary(scaler, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().scale == 2.0
