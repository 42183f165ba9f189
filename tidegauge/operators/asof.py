"""Point-in-time alignment of slow external series on the bar grid.

An external value is usable at ``t`` only if its ``release_date <= t``. The alignment does
not depend on the series, so it runs once on the distinct bar times: grid times and
releases meet in one aggregate on time, are filled forward inside time blocks, and the
last value of each earlier block is carried in through a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.blocks import SeriesSpec, time_bucket
from tidegauge.operators.intervals import interval_join
from tidegauge.operators.ordered import following
from tidegauge.session import materialise

REQUIRED = ("source", "release_date", "value")


def check_external(external: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in external.columns]
    if missing:
        raise ValueError(f"external series lacks {missing}; refusing to align without release dates")


def latest_per_release(external: DataFrame) -> DataFrame:
    """One row per (source, release_date): the latest fact wins, then the larger value.

    A value may be NULL: releasing "unknown" replaces the value before it.
    """
    check_external(external)
    rank = [c for c in ("value_date",) if c in external.columns]
    return (
        external.where(F.col("release_date").isNotNull())
        .groupBy("source", "release_date")
        .agg(F.max(F.struct(*rank, "value")).alias("_m"))
        .select("source", "release_date", F.col("_m.value").alias("value"))
    )


def align_grid(times: DataFrame, external: DataFrame, sources: Sequence[str], spec: SeriesSpec) -> DataFrame:
    """``(ts, <one column per source>)`` for every distinct time in ``times``.

    Per source a flag says whether something was released at a time and a value what; both
    are plain columns, so the merge of grid and releases is one hash aggregate.
    """
    facts = latest_per_release(external.where(F.col("source").isin(list(sources))))
    tags = [f"_f{i}" for i in range(len(sources))]
    stamp = times.schema[spec.ts].dataType.simpleString()

    def columns(flag: dict[str, Column], value: dict[str, Column]) -> list[Column]:
        return [c for t in tags for c in (flag[t].alias(f"{t}_set"), value[t].alias(t))]

    is_source = {t: F.col("source") == s for t, s in zip(tags, sources, strict=True)}
    events = facts.select(
        F.col("release_date").cast(stamp).alias(spec.ts),
        F.lit(False).alias("_grid"),
        *columns(is_source, {t: F.when(is_source[t], F.col("value")) for t in tags}),
    )
    nothing = F.lit(None).cast("double")
    grid = times.select(spec.ts, F.lit(True).alias("_grid"), *columns({t: F.lit(False) for t in tags}, {t: nothing for t in tags}))
    steps = (
        grid.unionByName(events)
        .groupBy(spec.ts)
        .agg(
            F.bool_or("_grid").alias("_grid"),
            *columns({t: F.bool_or(f"{t}_set") for t in tags}, {t: F.max(t) for t in tags}),
        )
        .withColumn("_tb", time_bucket(spec.ts, spec.bar_seconds, spec.block_rows))
    )
    fact = {t: F.when(F.col(f"{t}_set"), F.struct(F.col(t).alias("v"))) for t in tags}
    inside = Window.partitionBy("_tb").orderBy(spec.ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = steps.select(
        spec.ts, "_tb", "_grid", *[F.last(fact[t], ignorenulls=True).over(inside).alias(f"{t}_here") for t in tags]
    )
    # one row per time block: what each block leaves behind
    ends = steps.groupBy("_tb").agg(
        *columns(
            {t: F.bool_or(f"{t}_set") for t in tags},
            {t: F.max_by(t, F.when(F.col(f"{t}_set"), F.col(spec.ts))) for t in tags},
        )
    )
    before = Window.orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_tb", *[F.last(fact[t], ignorenulls=True).over(before).alias(f"{t}_in") for t in tags])
    return (
        filled.where("_grid")
        .join(carried, "_tb", "left")
        .select(
            spec.ts,
            *[F.coalesce(f"{t}_here", f"{t}_in")["v"].alias(s) for t, s in zip(tags, sources, strict=True)],
        )
    )


def align_sources(bars: DataFrame, external: DataFrame, sources: Sequence[str], spec: SeriesSpec) -> DataFrame:
    """``bars`` plus one column per source, every bar kept."""
    if not sources:
        return bars
    return bars.join(align_grid(bars.select(spec.ts), external, sources, spec), spec.ts, "left")


def asof_keyed(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    at: str,
    values: Sequence[str],
    within: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the latest row of ``right`` of its keys, at or before its time.

    Rows of both tables meet in range partitions on (keys, time), so one hot key spreads over
    many tasks. The last known value is filled forward inside a partition; a table with one
    row per key and partition carries it over the cuts.

    Several rows of ``right`` at one time count as one, the largest by ``values``. A value may be
    NULL and then replaces the one before it. ``within`` (an interval such as ``'7 days'``) drops
    older matches. Rows of ``left`` without a match, with a NULL key or a NULL time get NULLs;
    rows of ``right`` with a NULL key or time match nothing. Repeated rows of ``left`` all stay.
    """
    keys = list(keys)
    clash = [c for c in values if c in left.columns]
    if clash:
        raise ValueError(f"columns {clash} are in both tables; rename them first")
    stamp = left.schema[ts].dataType.simpleString()
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    here = known & F.col(ts).isNotNull()
    facts = (
        right.where(known & F.col(at).isNotNull())
        .select(*keys, F.col(at).cast(stamp).alias(ts), F.struct(*values).alias("_fact"))
        .groupBy(*keys, ts)
        .agg(F.max("_fact").alias("_fact"))
    )
    rows = left.where(here).select(*keys, ts, F.lit(True).alias("_late"), F.struct(*left.columns).alias("_row"))
    events = rows.unionByName(facts.withColumn("_late", F.lit(False)), allowMissingColumns=True)
    cuts = [*keys, ts]
    ranged = events.repartitionByRange(partitions, *cuts) if partitions else events.repartitionByRange(*cuts)
    parts = materialise(ranged.withColumn("_part", F.spark_partition_id()))
    found = F.when(~F.col("_late"), F.struct(F.col(ts).alias("t"), F.col("_fact").alias("v")))
    ends = parts.groupBy(*keys, "_part").agg(F.max(found).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(before).alias("_in"))
    inside = Window.partitionBy(*keys, "_part").orderBy(ts, "_late").rowsBetween(Window.unboundedPreceding, 0)
    filled = parts.withColumn("_here", F.last(found, ignorenulls=True).over(inside)).where("_late")
    hit = F.coalesce("_here", "_in")
    if within is not None:
        hit = F.when(hit["t"] >= F.col(ts) - F.expr(f"INTERVAL {within}"), hit)
    matched = filled.join(carried, [*keys, "_part"]).withColumn("_hit", hit)
    out = matched.select("_row.*", *[F.col("_hit.v")[c].alias(c) for c in values])
    fields = {f.name: f.dataType for f in right.schema}
    return out.unionByName(left.where(~here).withColumns({c: F.lit(None).cast(fields[c]) for c in values}))


def release_intervals(external: DataFrame) -> DataFrame:
    """``(source, valid_from, valid_to, value)``: each fact until the next release of its source."""
    facts = following(latest_per_release(external), ["source"], "release_date", "_next")
    return facts.select("source", F.col("release_date").alias("valid_from"), F.col("_next").alias("valid_to"), "value")


def align_intervals(times: DataFrame, external: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Long form ``(ts, source, value)``: what was valid at every distinct time."""
    facts = release_intervals(external)
    return interval_join(times, facts, spec.ts, "valid_from", "valid_to", ["source", "value"])
