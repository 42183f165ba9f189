"""Chronological splits with embargo, from the row number of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.blocks import ROW, ROWS

ORDER = ("train", "val", "test")


def _share(ratio: float) -> Column:
    """Whole rows in a share of the series."""
    return F.floor(F.col(ROWS) * F.lit(float(ratio)))


def split_bounds(train: float = 0.70, val: float = 0.15, test: float = 0.15, embargo: int = 24) -> dict[str, tuple[Column, Column]]:
    """Half-open row ranges; the embargo is cut from the end of train and val only."""
    total = train + val + test
    if total - 1.0 > 1e-6:
        raise ValueError(f"split ratios sum to {total:.4f}, more than 1")
    if embargo < 0:
        raise ValueError("embargo must not be negative")
    train_end = _share(train)
    val_end = train_end + _share(val)
    return {
        "train": (F.lit(0), train_end - embargo),
        "val": (train_end, val_end - embargo),
        "test": (val_end, val_end + _share(test)),
    }


def _long_enough(bounds: dict[str, tuple[Column, Column]]) -> Column:
    usable = F.lit(True)
    for start, end in bounds.values():
        usable = usable & (end - start > 0)
    return usable


def _checked(usable: Column, short: str, what: str) -> Column:
    """``usable``, or an error at the first row for which it is false."""
    if short not in ("raise", "exclude"):
        raise ValueError(f"short must be raise or exclude, not {short!r}")
    if short == "exclude":
        return usable
    return F.when(usable, True).otherwise(F.raise_error(F.format_string(f"series of %d rows is too short for {what}", ROWS)).cast("boolean"))


def chronological_split(
    df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15, embargo: int = 24, short: str = "raise"
) -> DataFrame:
    """Add ``split`` and ``split_row``, the row number inside the split; embargoed rows get NULL.

    A series too short for all three parts fails the job. With ``short="exclude"`` all of its
    rows get NULL instead; ``excluded_series`` lists those series.
    """
    bounds = split_bounds(train, val, test, embargo)
    usable = _checked(_long_enough(bounds), short, "the split")
    name, start_of = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for label in ORDER:
        start, end = bounds[label]
        inside = usable & (F.col(ROW) >= start) & (F.col(ROW) < end)
        name = F.when(inside, F.lit(label)).otherwise(name)
        start_of = F.when(inside, F.col(ROW) - start).otherwise(start_of)
    return df.withColumns({"split": name, "split_row": start_of})


def excluded_series(df: DataFrame, keys: Sequence[str] = ("symbol",), **split: float) -> DataFrame:
    """Keys and row counts of the series too short for the split."""
    return df.groupBy(*keys).agg(F.max(ROWS).alias(ROWS)).where(~_long_enough(split_bounds(**split)))


def require_splittable(df: DataFrame, keys: Sequence[str] = ("symbol",), **split: float) -> None:
    """Fail if some series is too short for the split."""
    found = excluded_series(df, keys, **split).limit(5).collect()
    if found:
        raise ValueError(f"series too short for the split: {[tuple(r) for r in found]}")


def fold_bounds(fold: Column, folds: int = 5, embargo: int = 24, first_train: float = 0.40) -> tuple[dict[str, tuple[Column, Column]], Column]:
    """Half-open train and val row ranges of an expanding fold, and whether the series is long enough for it."""
    if folds < 1:
        raise ValueError("folds must be at least 1")
    if not 0.0 < first_train < 1.0:
        raise ValueError("first_train must lie in (0, 1)")
    start = _share(first_train)
    size = F.floor((F.col(ROWS) - start) / folds)
    train_end = start + fold * size
    val_end = train_end + size - embargo
    usable = (size > embargo) & (val_end <= F.col(ROWS)) & (train_end - embargo > 0)
    return {"train": (F.lit(0), train_end - embargo), "val": (train_end, val_end)}, usable


def train_ranges(folds: int = 5, embargo: int = 24, first_train: float = 0.40) -> dict[int, tuple[Column, Column]]:
    """Train row range of every expanding fold, for ``lagsums.range_sums``."""
    return {k: fold_bounds(F.lit(k), folds, embargo, first_train)[0]["train"] for k in range(folds)}


def foldable(df: DataFrame, folds: int = 5, embargo: int = 24, first_train: float = 0.40, short: str = "raise") -> DataFrame:
    """``df`` if all its series are long enough for all folds; see ``walk_forward`` for ``short``."""
    usable = F.lit(True)
    for k in (0, folds - 1):  # the shortest train part and the last border
        usable = usable & fold_bounds(F.lit(k), folds, embargo, first_train)[1]
    return df.where(_checked(usable, short, "the folds"))


def walk_forward(df: DataFrame, folds: int = 5, embargo: int = 24, first_train: float = 0.40, short: str = "raise") -> DataFrame:
    """Rows of every expanding fold: adds ``fold`` and ``role`` (train or val).

    A row appears once per fold it takes part in. A series too short for a fold fails the
    job; with ``short="exclude"`` it has no rows in that fold.
    """
    bounds, usable = fold_bounds(F.col("fold"), folds, embargo, first_train)
    role = F.lit(None).cast("string")
    for name, (low, high) in bounds.items():
        role = F.when((F.col(ROW) >= low) & (F.col(ROW) < high), name).otherwise(role)
    return (
        df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .where(_checked(usable, short, "the folds"))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
    )


def cv_folds(df: DataFrame, splits: int = 3, shares: Sequence[float] = (0.2, 0.36, 0.52, 0.68, 0.84, 1.0)) -> DataFrame:
    """Time-ordered cross-validation times growing train prefixes.

    Adds ``fold``, ``train_rows`` and ``role``. Test blocks are equal and at the end; a
    prefix is a share of the first fold's train part and is the same in every fold.
    """
    block = F.floor(F.col(ROWS) / (splits + 1))
    first = F.col(ROWS) - splits * block
    sizes = F.array(*[F.greatest(F.floor(F.lit(float(s)) * first), F.lit(1)) for s in shares])
    test_start = first + F.col("fold") * block
    role = F.when(F.col(ROW) < F.col("train_rows"), "train").when(
        (F.col(ROW) >= test_start) & (F.col(ROW) < test_start + block), "val"
    )
    return (
        df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        .withColumn("train_rows", F.explode(F.array_distinct(sizes)))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
    )


def summarise_rows(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows, first and last time and the half-open row range of each group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.min(ROW).alias("start_idx"),
        (F.max(ROW) + 1).alias("end_idx"),
    )
