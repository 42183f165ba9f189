"""Points inside intervals, by a merge of time slots.

The time axis is cut at quantiles of the points, so that slots hold about equally many. An
interval is copied once into every slot it reaches, however long it is, and points and intervals
of a slot are merged in order: two binary searches give the points an interval covers. A slot
with many intervals is dealt into parts, each with a copy of the slot's points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialise

#: points of a slot, and intervals of one of its parts: a task's result has at most their product in rows
SLOT_POINTS, PART_INTERVALS = 4096, 512
_FAR = (1 << 62) - 1


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _slotted(df: DataFrame, time: str, name: str, borders: list[float]) -> DataFrame:
    """Add the number of the slot that holds ``time`` (microseconds)."""
    if not borders:
        return df.withColumn(name, F.lit(0))
    splits = [-float("inf"), *borders, float("inf")]
    spread = Bucketizer(splits=splits, inputCol="_double", outputCol="_slot_of", handleInvalid="error")
    placed = spread.transform(df.withColumn("_double", F.col(time).cast("double")))
    return placed.withColumn(name, F.col("_slot_of").cast("int")).drop("_double", "_slot_of")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    start: str,
    stop: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    slot_points: int = SLOT_POINTS,
    part_intervals: int = PART_INTERVALS,
) -> DataFrame:
    """``(keys, ts, values)``: every distinct point with every interval ``[start, stop)`` around it.

    With ``keys`` a point only meets intervals of the same keys. A NULL ``stop`` never ends. Rows
    with a NULL key, time or start and intervals that end before they begin meet nothing.
    Intervals may overlap and repeat. Points outside all intervals do not appear.
    """
    keys, values = list(keys), list(values)
    grid = points.select(*keys, ts, _micros(ts).alias("_t")).dropna().distinct()
    spans = intervals.select(*keys, *values, _micros(start).alias("_from"), F.coalesce(_micros(stop), F.lit(_FAR)).alias("_to"))
    spans = spans.where("_from < _to").dropna(subset=[*keys, "_from"])
    grid, spans = materialise(grid), materialise(spans)
    n = grid.count()
    slots = max(1, -(-n // slot_points))
    # distinct borders only: a time of many points stays in one slot
    cuts = grid.agg(F.percentile_approx("_t", [k / slots for k in range(1, slots)], 100 * slots)).first()[0] if slots > 1 else []
    borders = sorted({float(c) for c in cuts or []})
    placed = _slotted(grid, "_t", "_slot", borders)
    reach = spans.withColumn("_end", F.col("_to") - 1)
    copies = _slotted(_slotted(reach, "_from", "_first", borders), "_end", "_last", borders)
    copies = copies.withColumn("_slot", F.explode(F.sequence("_first", "_last"))).select(*keys, *values, "_slot", "_from", "_to")
    crowded = copies.groupBy(*keys, "_slot").agg(F.ceil(F.count(F.lit(1)) / part_intervals).cast("int").alias("_parts"))
    crowded = materialise(crowded.where("_parts > 1"))
    here = [*keys, "_slot"]
    parts = F.coalesce("_parts", F.lit(1))
    placed = placed.join(crowded, here, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dealt = F.pmod(F.xxhash64("_from", "_to", *values), parts).cast("int")
    copies = copies.join(crowded, here, "left").withColumn("_part", dealt).drop("_parts")
    wanted = points.schema
    kinds = {f.name: f.dataType.simpleString() for f in intervals.schema}
    schema = ", ".join(f"`{c}` {wanted[c].dataType.simpleString()}" for c in [*keys, ts]) + "".join(f", `{c}` {kinds[c]}" for c in values)

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_t")
        times = left.column("_t").to_numpy()
        lo = np.searchsorted(times, right.column("_from").to_numpy())
        hi = np.searchsorted(times, right.column("_to").to_numpy())
        size = hi - lo
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[of]
        left, right = left.take(pa.array(at, pa.int64())), right.take(pa.array(of, pa.int64()))
        return pa.table([left.column(c) for c in [*keys, ts]] + [right.column(c) for c in values], names=[*keys, ts, *values])

    group = [*here, "_part"]
    return placed.groupBy(*group).cogroup(copies.groupBy(*group)).applyInArrow(merge, schema)
