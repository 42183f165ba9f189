"""Integrity checks. Each returns ``(symbol, severity, code, message, n, details)`` rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.blocks import Blocked, SeriesSpec, index_rows

SEVERITIES = ("info", "warning", "error")
PRICES = ("open", "high", "low", "close")


def _issue(df: DataFrame, severity: str, code: str, message: Column, n: Column, details: Column) -> DataFrame:
    return df.select(
        "symbol",
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        message.alias("message"),
        n.cast("bigint").alias("n"),
        details.cast("map<string,string>").alias("details"),
    ).where(F.col("n") > 0)


def _n_details(name: str, n: str = "n") -> Column:
    return F.create_map(F.lit(name), F.col(n).cast("string"))


def duplicate_counts(df: DataFrame, subset: Sequence[str], key: str = "symbol") -> DataFrame:
    """Rows sharing their ``subset`` values with another row, all copies counted."""
    return (
        df.groupBy(*dict.fromkeys([key, *subset]))
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy(F.col(key).alias("symbol"))
        .agg(F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("n"))
    )


def check_duplicates(df: DataFrame, subset: Sequence[str], key: str = "symbol") -> DataFrame:
    text = F.concat(F.col("n"), F.lit(f" duplicated rows on {list(subset)}"))
    return _issue(
        duplicate_counts(df, subset, key), "error", "DUPLICATES", text, F.col("n"), _n_details("n_duplicates")
    )


def order_violations(df: DataFrame, seq: str, ts: str = "ts", key: str = "symbol", span: int = 65536) -> DataFrame:
    """Rows whose time lies before the time of the row ingested just before them.

    ``seq`` numbers the rows; runs of ``span`` numbers are checked inside, their edges against
    each other, so no series is read in one task.
    """
    runs = df.withColumn("_run", F.floor(F.col(seq) / span))
    order = Window.partitionBy(key, "_run").orderBy(seq)
    flagged = runs.withColumn("_bad", (F.lag(ts).over(order) > F.col(ts)).cast("bigint"))
    edges = flagged.groupBy(key, "_run").agg(
        F.sum("_bad").alias("_inner"), F.min_by(ts, seq).alias("_head"), F.max_by(ts, seq).alias("_tail")
    )
    across = Window.partitionBy(key).orderBy("_run")
    return (
        edges.withColumn("_edge", (F.lag("_tail").over(across) > F.col("_head")).cast("bigint"))
        .groupBy(F.col(key).alias("symbol"))
        .agg((F.coalesce(F.sum("_inner"), F.lit(0)) + F.coalesce(F.sum("_edge"), F.lit(0))).alias("n"))
    )


def check_order(df: DataFrame, seq: str, ts: str = "ts", key: str = "symbol", span: int = 65536) -> DataFrame:
    """Time must be a time type and non-decreasing in ingest order."""
    kind = df.schema[ts].dataType.simpleString()
    if kind not in ("timestamp", "timestamp_ntz", "date"):
        series = df.groupBy(F.col(key).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
        text = F.lit(f"time column is {kind}, expected a timestamp")
        return _issue(series, "error", "INDEX_NOT_DATETIME", text, F.lit(1), F.create_map())
    text = F.concat(F.col("n"), F.lit(" rows out of time order"))
    return _issue(
        order_violations(df, seq, ts, key, span), "error", "INDEX_NOT_MONOTONIC", text, F.col("n"), _n_details("n_rows")
    )


def ohlc_violations(df: DataFrame) -> DataFrame:
    o, h, lo, c = (F.col(p) for p in PRICES)
    return df.groupBy("symbol").agg(
        F.count_if((h < o) | (h < c) | (h < lo)).alias("bad_high"),
        F.count_if((lo > o) | (lo > c) | (lo > h)).alias("bad_low"),
    )


def check_ohlc(df: DataFrame) -> DataFrame:
    counts = ohlc_violations(df)
    parts = [
        _issue(
            counts,
            "error",
            f"OHLC_{side.upper()}_INCONSISTENT",
            F.concat(F.col(f"bad_{side}"), F.lit(f" rows where {side} does not bound the bar")),
            F.col(f"bad_{side}"),
            _n_details("n_rows", f"bad_{side}"),
        )
        for side in ("high", "low")
    ]
    return parts[0].unionByName(parts[1])


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, column, n)`` for columns with missing values."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(list(keys), list(columns), "column", "n").where(F.col("n") > 0)


def check_nulls(df: DataFrame, columns: Sequence[str] = PRICES) -> DataFrame:
    per_column = (
        null_counts(df, columns)
        .groupBy("symbol")
        .agg(
            F.sum("n").alias("n"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", F.col("n").cast("string"))))).alias("d"),
        )
    )
    text = F.concat(F.col("n"), F.lit(" missing values"))
    return _issue(per_column, "warning", "NAN_VALUES", text, F.col("n"), F.col("d"))


def bar_gaps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``(keys, ts, gap_hours)`` for every bar that has one before it."""
    blocked = Blocked.of(index_rows(df.select(*spec.keys, spec.ts), spec), spec, back=1)
    seconds = (F.unix_micros(F.col(spec.ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / 1e6
    return (
        blocked.run([{"_before": blocked.lag(spec.ts, 1)}])
        .home()
        .where(F.col("_before").isNotNull())
        .select(*spec.keys, spec.ts, F.col("_before").alias("prev_ts"), (seconds / 3600.0).alias("gap_hours"))
    )


def weekend(ts: str = "ts", prev: str = "prev_ts") -> Column:
    """From a Friday to a Sunday or Monday."""
    return (F.weekday(prev) == 4) & F.weekday(ts).isin(6, 0)


def gap_counts(df: DataFrame, spec: SeriesSpec, weekday_hours: float = 2, weekend_hours: float = 60) -> DataFrame:
    """Long gaps with their class, before counting."""
    normal = weekend(spec.ts) & (F.col("gap_hours") <= weekend_hours)
    return bar_gaps(df, spec).where(F.col("gap_hours") > weekday_hours).withColumn(
        "code", F.when(normal, F.lit("WEEKEND_GAPS")).otherwise(F.lit("WEEKDAY_GAPS"))
    )


def check_gaps(df: DataFrame, spec: SeriesSpec, weekday_hours: float = 2, weekend_hours: float = 60) -> DataFrame:
    """Weekend gaps inform, other long gaps warn with the first five as examples."""
    gaps = gap_counts(df, spec, weekday_hours, weekend_hours)
    counts = gaps.groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("symbol", "code").orderBy(spec.ts)
    shown = F.struct(F.col(spec.ts).alias("t"), "gap_hours")
    examples = (
        gaps.withColumn("_k", F.row_number().over(first))
        .where(F.col("_k") <= 5)
        .groupBy("symbol", "code")
        .agg(F.to_json(F.array_sort(F.collect_list(shown))).alias("examples"))
    )
    full = counts.join(examples, ["symbol", "code"])
    busy = full.where(F.col("code") == "WEEKDAY_GAPS")
    calm = full.where(F.col("code") == "WEEKEND_GAPS")
    details = F.create_map(F.lit("n_gaps"), F.col("n").cast("string"), F.lit("examples"), F.col("examples"))
    return _issue(
        busy, "warning", "WEEKDAY_GAPS", F.concat(F.col("n"), F.lit(" gaps inside the week")), F.col("n"), details
    ).unionByName(
        _issue(
            calm, "info", "WEEKEND_GAPS", F.concat(F.col("n"), F.lit(" weekend gaps")), F.col("n"), _n_details("n_gaps")
        )
    )


def check_volume(df: DataFrame) -> DataFrame:
    flat = df.groupBy("symbol").agg(F.bool_and(F.coalesce(F.col("volume") == 0, F.lit(False))).alias("flat"))
    return _issue(
        flat.where("flat"), "info", "VOLUME_ALL_ZERO", F.lit("volume is zero on every bar"), F.lit(1), F.create_map()
    )


def validation_report(df: DataFrame, spec: SeriesSpec, seq: str | None = None) -> DataFrame:
    """All checks on a bar table; the order check needs an ingest sequence column."""
    checks = [
        check_duplicates(df, [spec.ts]),
        check_ohlc(df),
        check_nulls(df),
        check_gaps(df, spec),
        check_volume(df),
    ]
    if seq is not None:
        checks.insert(0, check_order(df, seq, spec.ts))
    return reduce(DataFrame.unionByName, checks)


def issue_summary(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Issues per severity, every severity present."""
    return issues.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def raise_if_errors(issues: DataFrame, shown: int = 20) -> None:
    """Fail if any issue is an error, naming at most ``shown`` of them."""
    errors = issues.where(F.col("severity") == "error")
    found = errors.orderBy("symbol", "code").limit(shown).collect()
    if found:
        lines = "\n".join(f"[{r.symbol}] {r.code}: {r.message}" for r in found)
        raise ValueError(f"validation failed with {errors.count()} error(s):\n{lines}")
