"""Running totals, ranks and exact quantiles over a value order.

A window over all values of a group is one task. These operators cut the sorted order into
range partitions (equal values collapse first, so no cut falls inside a tie), total each
partition, and add the totals of the earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import materialise, ship_package

_PART = "_part"


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Column | str,
    sums: Sequence[str],
    partitions: int | None = None,
) -> DataFrame:
    """Add ``<c>_before`` and ``<c>_total`` for every column in ``sums``.

    ``df`` must hold one row per (keys, order).
    """
    keys = list(keys)
    ordered = df.withColumn("_ord", F.col(order) if isinstance(order, str) else order)
    ranged = (
        ordered.repartitionByRange(partitions, *keys, "_ord")
        if partitions
        else ordered.repartitionByRange(*keys, "_ord")
    )
    parts = materialise(ranged.withColumn(_PART, F.spark_partition_id()))
    totals = parts.groupBy(*keys, _PART).agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys,
        _PART,
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(group).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy(*keys, _PART).orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = local.join(starts, [*keys, _PART])
    return joined.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.col(f"_l_{c}") for c in sums}).drop(
        "_ord", _PART, *[f"_b_{c}" for c in sums], *[f"_l_{c}" for c in sums]
    )


def following(df: DataFrame, keys: Sequence[str], order: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add the next larger ``order`` value of the same keys as ``name`` (NULL for the last).

    ``df`` must hold one row per (keys, order). A partition takes the value for its last row
    from the first row of the next partition that has the key.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(partitions, *keys, order) if partitions else df.repartitionByRange(*keys, order)
    parts = materialise(ranged.withColumn(_PART, F.spark_partition_id()))
    heads = parts.groupBy(*keys, _PART).agg(F.min(order).alias("_head"))
    ahead = heads.select(*keys, _PART, F.lead("_head").over(Window.partitionBy(*keys).orderBy(_PART)).alias("_ahead"))
    inside = Window.partitionBy(*keys, _PART).orderBy(order)
    local = parts.withColumn("_inside", F.lead(order).over(inside))
    return local.join(ahead, [*keys, _PART]).withColumn(name, F.coalesce("_inside", "_ahead")).drop(_PART, "_inside", "_ahead")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values with their count ``n``, the count before them and in total.

    ``weight`` names a count column when the rows are already grouped.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    return running_totals(distinct, keys, value, ["n"])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """1-based ranks of the distinct values, ties sharing the mean rank, as ``rank``."""
    return value_counts(df, keys, value, weight).select(
        *keys, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``(keys, p, q)`` with linear interpolation between the two neighbouring order values."""
    ranked = value_counts(df, keys, value)
    hits = (
        ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", F.col("p") * (F.col("n_total") - 1))
        .withColumn("_lo", F.floor("_pos"))
        .withColumn("_hi", F.ceil("_pos"))
        .withColumn("_last", F.col("n_before") + F.col("n") - 1)
        .where((F.col("n_before") <= F.col("_hi")) & (F.col("_last") >= F.col("_lo")))
    )
    low = F.max(F.when((F.col("n_before") <= F.col("_lo")) & (F.col("_last") >= F.col("_lo")), F.col(value)))
    high = F.max(F.when((F.col("n_before") <= F.col("_hi")) & (F.col("_last") >= F.col("_hi")), F.col(value)))
    return (
        hits.groupBy(*keys, "p")
        .agg(low.alias("_vl"), high.alias("_vh"), F.max(F.col("_pos") - F.col("_lo")).alias("_w"))
        .select(*keys, "p", (F.col("_vl") + (F.col("_vh") - F.col("_vl")) * F.col("_w")).alias("q"))
    )


#: Bits found per pass, and the most order values that passes over the rows look for at once.
DIGIT, TARGETS = 8, 4096


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0.0 and 0.0 are one value."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_ordered_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.uint64(raw).view(np.float64))


def wide_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], targets: int = TARGETS) -> DataFrame:
    """``(keys, feature, p, q)`` of many columns with linear interpolation, exact, without a shuffle of the values.

    The order value at a rank is found bit by bit: a pass counts, for every wanted value of
    every group and column at once, the next ``DIGIT`` bits of the rows that share the bits
    known so far, and the counts tell which bits come next. Only these counters are shuffled.
    ``df`` is read once a pass, so hand in a stored or materialised frame. Up to ``targets``
    values at a time are looked for, which bounds the counters; a table with more groups is
    sorted by value instead (``exact_quantiles``). NULLs do not count; a column without a value
    in a group has no row.
    """
    keys, columns = list(keys), list(columns)
    spark = df.sparkSession
    most = max(1, targets // (len(probs) * 2 * len(columns)))
    group = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("long")
    sizes = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{i}") for i, c in enumerate(columns)]).withColumn("_g", group)
    held = sizes.limit(most + 1).collect()
    if len(held) > most or len({r["_g"] for r in held}) < len(held):
        return exact_quantiles(to_long(df, keys, columns), [*keys, "feature"], "value", probs)
    # bits known so far and rank among the rows that share them, per (group, column, rank)
    state = {}
    for r in held:
        for i in range(len(columns)):
            last = r[f"_n_{i}"] - 1
            for p in probs if last >= 0 else ():
                for rank in (int(np.floor(p * last)), int(np.ceil(p * last))):
                    state[r["_g"], i, rank] = (0, rank)
    rows = df.select(group.alias("_g"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    ship_package(spark)
    schema = pa.schema([("node", pa.int32()), ("digit", pa.int32()), ("n", pa.int64())])
    for shift in range(64 - DIGIT, -1, -DIGIT):
        nodes = sorted({(i, g, known) for (g, i, _), (known, _) in state.items()})
        place = {node: k for k, node in enumerate(nodes)}

        def count(batches: Iterator[pa.RecordBatch], nodes=nodes, shift=shift) -> Iterator[pa.RecordBatch]:
            totals = np.zeros(len(nodes) << DIGIT, dtype=np.int64)
            by_column: dict[int, list[tuple[int, int, int]]] = {}
            for k, (i, g, known) in enumerate(nodes):
                by_column.setdefault(i, []).append((g, known, k))
            for batch in batches:
                groups = batch.column("_g").to_numpy()
                of_group = {g: groups == g for g in {g for _, g, _ in nodes}}
                for i, wanted in by_column.items():
                    column = batch.column(f"_{i}")
                    there = column.is_valid().to_numpy(zero_copy_only=False)
                    bits = ordered_bits(column.fill_null(0.0).to_numpy(zero_copy_only=False))
                    head = bits >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros(len(bits), dtype=np.uint64)
                    digit = ((bits >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                    for g, known, k in wanted:
                        same = digit[there & of_group[g] & (head == np.uint64(known))]
                        totals[k << DIGIT : (k + 1) << DIGIT] += np.bincount(same, minlength=1 << DIGIT)
            at = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(at >> DIGIT, pa.int32()), pa.array(at & ((1 << DIGIT) - 1), pa.int32()), pa.array(totals[at])], schema=schema)

        counts = np.zeros((len(nodes), 1 << DIGIT), dtype=np.int64)
        for r in rows.mapInArrow(count, "node int, digit int, n long").groupBy("node", "digit").agg(F.sum("n").alias("n")).collect():
            counts[r.node, r.digit] = r.n
        upto = counts.cumsum(axis=1)
        for (g, i, rank), (known, left) in state.items():
            line = upto[place[i, g, known]]
            digit = int(np.searchsorted(line, left, side="right"))
            state[g, i, rank] = ((known << DIGIT) | digit, left - (int(line[digit - 1]) if digit else 0))
    out = []
    for r in held:
        for i, c in enumerate(columns):
            last = r[f"_n_{i}"] - 1
            for p in probs if last >= 0 else ():
                lo, hi = int(np.floor(p * last)), int(np.ceil(p * last))
                low, high = (from_ordered_bits(state[r["_g"], i, k][0]) for k in (lo, hi))
                out.append((*[r[k] for k in keys], c, float(p), low + (high - low) * (p * last - lo)))
    key_types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return spark.createDataFrame(out, f"{key_types}feature string, p double, q double")


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column): ``keys``, the column name and its value as double."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )
