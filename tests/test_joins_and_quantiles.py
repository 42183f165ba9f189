"""Keyed as-of, interval joins and wide quantiles against pandas on tables with every odd case."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.asof import asof_keyed, release_intervals
from tidegauge.operators.intervals import interval_join
from tidegauge.operators.ordered import following, from_ordered_bits, ordered_bits, wide_quantiles

DAY = datetime(2024, 1, 1)


def times(rng, n, hours=400):
    return [DAY + timedelta(hours=int(h)) for h in rng.integers(0, hours, n)]


@pytest.mark.parametrize("within", [None, "30 hours"])
def test_asof_keyed_equals_brute_force(spark, within):
    rng = np.random.default_rng(1)
    keys = lambda n: [None if x == 9 else ("hot" if x < 5 else f"k{x}") for x in rng.integers(0, 10, n)]
    left = list(zip(range(500), keys(500), [*times(rng, 495), None, None, *[DAY] * 3]))
    right = list(zip(keys(120), [*times(rng, 118), None, DAY], [None if x == 0 else float(x) for x in rng.integers(0, 50, 120)], ["x"] * 120))
    got = asof_keyed(
        spark.createDataFrame(left, "id long, k string, ts timestamp"),
        spark.createDataFrame(right, "k string, at timestamp, v double, tag string"),
        ["k"], "ts", "at", ["v", "tag"], within, partitions=7,
    )
    held = {r.id: (r.v, r.tag) for r in got.collect()}
    assert got.count() == len(left) and set(held) == set(range(500))
    for i, k, t in left:
        past = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        want = (None, None)
        if past:
            last = max(r[1] for r in past)
            # NULL sorts below every value
            v = max((r[2] for r in past if r[1] == last), key=lambda x: -1.0 if x is None else x)
            if within is None or last >= t - timedelta(hours=30):
                want = (v, "x")
        assert held[i] == want


def test_asof_keyed_plan_has_no_single_partition(spark):
    left = spark.range(1000).select((F.col("id") % 2).alias("k"), F.timestamp_seconds("id").alias("ts"))
    right = left.select("k", F.col("ts").alias("at"), F.lit(1.0).alias("v"))
    plan = asof_keyed(left, right, ["k"], "ts", "at", ["v"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert asof_keyed(left.limit(0), right, ["k"], "ts", "at", ["v"]).count() == 0
    assert asof_keyed(left, right.limit(0), ["k"], "ts", "at", ["v"]).where("v is not null").count() == 0
    with pytest.raises(ValueError, match="both tables"):
        asof_keyed(left, right.withColumnRenamed("v", "ts"), ["k"], "ts", "at", ["ts"])


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("slot,part", [(4096, 512), (16, 3)])
def test_interval_join_equals_brute_force(spark, keys, slot, part):
    rng = np.random.default_rng(2)
    points = list(zip(["a", "b", None, "a"] * 75, [*times(rng, 298), None, DAY]))
    spans = []
    for j, (k, a) in enumerate(zip(["a", "b", "a", None] * 20, [*times(rng, 79), None])):
        length = int(rng.choice((-3, 0, 1, 24, 900)))
        spans.append((k, a, None if j % 11 == 0 or a is None else a + timedelta(hours=length), j if j % 7 else None))
    got = interval_join(
        spark.createDataFrame(points, "k string, ts timestamp"), spark.createDataFrame(spans, "k string, a timestamp, b timestamp, j long"),
        "ts", "a", "b", ["j"], keys, slot, part,
    )
    at = 0 if keys else 1
    seen = {p[at:] for p in points if p[1] is not None and (not keys or p[0] is not None)}
    want = [(*p, j) for p in seen for k, a, b, j in spans if a is not None and a <= p[-1] and (b is None or p[-1] < b) and (not keys or k == p[0])]
    assert got.columns == [*keys, "ts", "j"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*w[:-2], w[-2], w[-1])) for w in want)


def test_interval_copies_do_not_grow_with_length(spark):
    points = spark.range(2000).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    spans = spark.createDataFrame([(DAY, DAY + timedelta(days=40_000), 1)], "a timestamp, b timestamp, j int")
    assert interval_join(points, spans, "ts", "a", "b", ["j"]).count() == 0
    spans = spans.withColumn("a", F.timestamp_seconds(F.lit(0)))
    out = interval_join(points, spans, "ts", "a", "b", ["j"])
    assert out.count() == 2000


def test_following_crosses_partitions(spark):
    rows = [(k, v) for k in ("a", "b") for v in range(0, 300, 3)] + [("c", 1)]
    got = following(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", "nxt", 9).collect()
    assert {(r.k, r.v): r.nxt for r in got} == {(k, v): v + 3 if k != "c" and v < 297 else None for k, v in rows}


def test_release_intervals_end_at_the_next_release(spark):
    facts = [("s", DAY, 1.0), ("s", DAY + timedelta(days=2), 2.0), ("u", DAY, 3.0)]
    got = release_intervals(spark.createDataFrame(facts, "source string, release_date timestamp, value double")).collect()
    assert {(r.source, r.value): r.valid_to for r in got} == {("s", 1.0): (DAY + timedelta(days=2)), ("s", 2.0): None, ("u", 3.0): None}


def test_ordered_bits_keep_the_order():
    values = np.array([-np.inf, -1e300, -1.5, -1e-310, -0.0, 0.0, 1e-310, 2.0, 1e300, np.inf])
    bits = ordered_bits(values)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert [from_ordered_bits(int(b)) for b in bits] == [float(v) + 0.0 for v in values]


@pytest.mark.parametrize("targets", [4096, 8])
def test_wide_quantiles_equal_pandas(spark, targets):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 900), "x": rng.normal(0, 1e3, 900), "y": rng.choice([-0.0, 0.0, 1.0, -2.5], 900), "z": 10.0 ** rng.integers(-300, 300, 900)})
    table.loc[::5, "x"] = np.nan
    table.loc[table.k == "c", "y"] = np.nan
    frame = spark.createDataFrame(table).replace(float("nan"), None).repartition(4)
    got = wide_quantiles(frame, ["k"], ["x", "y", "z"], [0.0, 0.25, 0.5, 1.0], targets)
    held = {(r.k, r.feature, r.p): r.q for r in got.collect()}
    want = {(k, c, p): v for c in ("x", "y", "z") for (k, p), v in table.groupby("k")[c].quantile([0.0, 0.25, 0.5, 1.0]).items() if not np.isnan(v)}
    assert set(held) == set(want)
    assert all(held[k] == pytest.approx(v, rel=1e-12, abs=0) for k, v in want.items())
    whole = {r.feature: r.q for r in wide_quantiles(frame, [], ["x", "z"], [0.5], targets).collect()}
    assert whole == pytest.approx({c: table[c].median() for c in ("x", "z")}, rel=1e-12)
    assert wide_quantiles(frame.limit(0), ["k"], ["x"], [0.5]).count() == 0
