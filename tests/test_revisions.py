"""Bars of a stream under shuffled and late ticks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegauge.operators.bars import build_bars
from tidegauge.streaming.revisions import latest_bars, revised_bars

SCHEMA = "name string, ts timestamp, price double, n long"


def replayed(spark, tmp_path, batches, lateness):
    """Each batch is one micro-batch of a query that restarts from its checkpoint."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        batch.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        rows = revised_bars(stream, key="name", ts="ts", price="price", order=F.col("n"), lateness=lateness)
        query = rows.writeStream.format("parquet").partitionBy("kind").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(50)
    return spark.read.schema(rows.schema).parquet(out)


def ticks(n=600, seed=5):
    rng = np.random.default_rng(seed)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 72 * 3600, n)), unit="s")
    return pd.DataFrame({"name": rng.choice(["a", "b"], n), "ts": at, "price": rng.normal(100, 5, n).round(3), "n": np.arange(n)})


def rows_of(spark, given):
    plain = lambda v: None if pd.isna(v) else v
    return spark.createDataFrame([(plain(a), t.to_pydatetime(), plain(float(p)), int(n)) for a, t, p, n in given.itertuples(index=False)], SCHEMA)


def test_shuffled_ticks_give_the_bars_of_the_batch(spark, tmp_path):
    given = ticks()
    given.loc[::50, "price"] = np.nan
    given.loc[1::50, "name"] = None
    frame = rows_of(spark, given)
    parts = [frame.where(F.pmod(F.xxhash64("n"), F.lit(3)) == k) for k in range(3)]
    rows = replayed(spark, tmp_path, parts, "30 days")
    got = latest_bars(rows).drop("revision")
    want = build_bars(frame, key="name", ts="ts", price="price", order=F.col("n"))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert rows.where("kind <> 'revision'").count() == 0
    assert rows.groupBy("symbol", "ts").agg(F.count("*").alias("k"), F.max("revision").alias("m"), F.min("revision").alias("f")).where("k <> m or f <> 1").count() == 0


def test_late_ticks_leave_by_the_side(spark, tmp_path):
    given = ticks(400, 8)
    rng = np.random.default_rng(1)
    arrival = given["ts"] + pd.to_timedelta(rng.integers(0, 12 * 3600, len(given)), unit="s")
    batch = ((arrival - arrival.min()) / pd.Timedelta("20h")).astype(int)
    rows = replayed(spark, tmp_path, [rows_of(spark, given[batch == k]) for k in range(batch.max() + 1)], "2 hours").toPandas()
    start = given["ts"].dt.floor("h")
    seen = pd.Series([given["ts"][batch < k].max() for k in batch]) - pd.Timedelta("2h")
    late = (start + pd.Timedelta("1h")) <= seen
    assert 20 < late.sum() < 200
    got = rows[rows.kind == "late"]
    assert sorted(got.tick_order.astype(int)) == list(given["n"][late])
    assert (got.sort_values("tick_order").price.to_numpy() == given["price"][late].to_numpy()).all()
    bars = rows[rows.kind == "revision"].sort_values("revision").groupby(["symbol", "ts"]).last()
    kept = given[~late].assign(start=start, batch=batch).groupby(["name", "start"])
    want = pd.DataFrame({"open": kept.price.first(), "high": kept.price.max(), "low": kept.price.min(), "close": kept.price.last(), "n_ticks": kept.n.count(), "revision": kept.batch.nunique()})
    assert list(bars.index) == list(want.index)
    assert (bars[want.columns].to_numpy() == want.to_numpy()).all()
    done = rows[rows.kind == "final"]
    assert not done.duplicated(["symbol", "ts"]).any()
    last = given["ts"][batch < batch.max()].max() - pd.Timedelta("2h")
    over = {(s, t) for s, t in want.index if t + pd.Timedelta("1h") < last}
    assert over <= set(zip(done.symbol, done.ts))
    assert all(bars.loc[(r.symbol, r.ts)].revision == r.revision for r in done.itertuples())


def test_no_ticks_no_rows(spark, tmp_path):
    assert replayed(spark, tmp_path, [spark.createDataFrame([], SCHEMA)], "2 hours").count() == 0
