"""Registered queries against their SQL twins on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidegauge.plans import testbed as tb
from tidegauge.streaming.bars import streaming_bars

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = (
    "ohlcv_bars", "daily_bars", "asof_multi", "macd", "target_clf", "validation_report", "series_summary",
    "sequences", "train_medians", "ar_labels", "regression_metrics", "roc_auc",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return str(v) if not isinstance(v, (int, float, str)) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, DATA)
    want = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_contract_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_stream_gives_the_same_bars(spark, tmp_path):
    events = tb.table(spark, DATA, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    bars = streaming_bars(stream, key="event_type", ts="ts", price="value", order=F.col("event_id"))
    query = bars.writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = spark.table("bars_out"), tb.hourly_bars(spark, DATA)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
