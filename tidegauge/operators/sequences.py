"""Windows of consecutive rows as model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.technical import side_by_side
from tidegauge.operators.blocks import ROW, Blocked, SeriesSpec, Stages

ROLLING = ("mean", "std", "min", "max")


def sequence_windows(
    indexed: DataFrame, spec: SeriesSpec, features: Sequence[str], keep: Sequence[str], target: str, lookback: int = 168
) -> DataFrame:
    """One row per window: ``x`` holds ``lookback`` rows of features as float arrays.

    Windows end at rows with a target. They reach back over split borders, so a segment's
    first windows use the rows before it. Missing features stay missing.
    """
    if lookback < 1:
        raise ValueError("lookback must be at least 1")
    b = Blocked.of(indexed, spec, back=lookback - 1)
    row = F.array(*[F.col(c).cast("float") for c in features])
    plan: Stages = [{"_row": row}, {"x": F.collect_list("_row").over(b.frame(lookback))}]
    return (
        b.run(plan)
        .home()
        .where((F.size("x") == lookback) & F.col(target).isNotNull())
        .select(*spec.keys, spec.ts, *keep, "x")
    )


def context_windows(indexed: DataFrame, spec: SeriesSpec, length: int = 512, close: str = "close") -> DataFrame:
    """The last ``length`` closes up to each row, fewer at the start of a series."""
    b = Blocked.of(indexed, spec, back=length - 1)
    context = F.collect_list(F.col(close).cast("float")).over(b.frame(length))
    return b.run([{"context": context}]).home().select(*spec.keys, spec.ts, "context")


def rolling_stages(b: Blocked, features: Sequence[str], aggregations: Sequence[str], lookback: int) -> Stages:
    """``<feature>_<agg>_<lookback>`` for every pair."""
    makers = {"mean": b.mean, "std": b.std, "min": b.min, "max": b.max}
    unknown = [a for a in aggregations if a not in makers]
    if unknown:
        raise ValueError(f"unknown aggregations {unknown}; known: {list(makers)}")
    return side_by_side(
        *[[{f"{c}_{a}_{lookback}": makers[a](c, lookback)}] for a in aggregations for c in features]
    )


def tabular_windows(
    indexed: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    target: str,
    lookback: int = 168,
    aggregations: Sequence[str] = (),
) -> DataFrame:
    """Feature rows with a target, optionally with rolling statistics of every feature."""
    names = [f"{c}_{a}_{lookback}" for a in aggregations for c in features]
    if not aggregations:
        return indexed.where(F.col(target).isNotNull()).select(*spec.keys, spec.ts, *features, target)
    b = Blocked.of(indexed, spec, back=lookback - 1)
    rows = b.run(rolling_stages(b, features, aggregations, lookback)).home()
    return rows.where((F.col(ROW) >= lookback - 1) & F.col(target).isNotNull()).select(
        *spec.keys, spec.ts, *features, *names, target
    )
