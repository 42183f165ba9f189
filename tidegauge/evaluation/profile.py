"""Descriptive tables of bars, externals and feature frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.evaluation.diagnostics import histogram
from tidegauge.functions.stats import pearson, sample_kurtosis, sample_skewness
from tidegauge.functions.technical import log_returns
from tidegauge.operators.blocks import Blocked, SeriesSpec, index_rows
from tidegauge.operators.lagsums import SUMS, correlation_of_sums, lag_products
from tidegauge.operators.ordered import exact_quantiles, to_long, wide_quantiles
from tidegauge.operators.validate import gap_counts, weekend
from tidegauge.session import materialise


def bar_returns(bars: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``(keys, ts, r, pct)``: 1-bar log-return and relative change."""
    b = Blocked.of(index_rows(bars.select(*spec.keys, spec.ts, "close"), spec), spec, back=1)
    rows = b.run(log_returns(b), [{}, {"pct": b.pct_change("close", 1)}]).home()
    return rows.select(*spec.keys, spec.ts, F.col("logret_1").alias("r"), "pct")


def series_summary(bars: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows, span, days, price range and median absolute bar return per series."""
    keys, ts = list(spec.keys), spec.ts
    days = F.floor((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 86400e6)
    base = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.round(days / 365.25, 2).alias("span_years"),
        F.min("low").alias("price_min"),
        F.max("high").alias("price_max"),
    )
    unique_days = (
        bars.select(*keys, F.to_date(ts).alias("d")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_unique_days"))
    )
    moves = bar_returns(bars, spec).withColumn("m", F.abs("pct"))
    median = exact_quantiles(moves, keys, "m", [0.5]).select(*keys, (F.col("q") * 100).alias("median_return_pct"))
    return base.join(unique_days, keys).join(median, keys, "left")


def null_rates(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), top: int = 8) -> DataFrame:
    """Share of missing values per column, the ``top`` largest."""
    rates = df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = rates.unpivot(list(keys), list(columns), "column", "rate")
    return long.orderBy(F.desc("rate"), "column").limit(top)


def class_balance(df: DataFrame, target: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return df.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("n"))


def target_stats(df: DataFrame, target: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean and sample deviation in basis points."""
    return df.groupBy(*keys).agg(
        (F.avg(target) * 1e4).alias("mean_bp"), (F.stddev_samp(target) * 1e4).alias("std_bp")
    )


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """count, mean, std, min, quartiles and max per series and column."""
    group = [*keys, "column"]
    long = to_long(df, keys, columns, "column")
    base = long.groupBy(*group).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    stored = materialise(df.select(*keys, *columns))
    quart = (
        wide_quantiles(stored, keys, columns, [0.25, 0.5, 0.75])
        .withColumnRenamed("feature", "column")
        .groupBy(*group)
        .agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    )
    return base.join(quart, group, "left")


def return_moments(bars: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean and deviation in basis points, bias-corrected skewness and excess kurtosis."""
    r = bar_returns(bars, spec).where(F.col("r").isNotNull())
    return r.groupBy(*spec.keys).agg(
        (F.avg("r") * 1e4).alias("mean_bp"),
        (F.stddev_samp("r") * 1e4).alias("std_bp"),
        sample_skewness("r").alias("skew"),
        sample_kurtosis("r").alias("kurt"),
    )


def hourly_volatility(bars: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean absolute log-return in percent per hour of day."""
    r = bar_returns(bars, spec)
    return r.where(F.col("r").isNotNull()).groupBy(*spec.keys, F.hour(spec.ts).alias("hour")).agg(
        (F.avg(F.abs("r")) * 100).alias("mean_abs_pct")
    )


def autocorrelation(bars: DataFrame, spec: SeriesSpec, lags: int = 49) -> DataFrame:
    """Autocorrelation of returns and squared returns at lags ``1..lags``."""
    b = Blocked.of(index_rows(bars.select(*spec.keys, spec.ts, "close"), spec), spec, back=lags + 1)
    b = b.run(log_returns(b), [{}, {"squared": F.col("logret_1") * F.col("logret_1")}])
    sums = lag_products(b, ["logret_1", "squared"], lags).groupBy(*spec.keys, "column", "lag").agg(*[F.sum(s).alias(s) for s in SUMS])
    acf = sums.where("n > 0").withColumn("acf", correlation_of_sums())
    pick = lambda column: F.max(F.when(F.col("column") == column, F.col("acf")))
    return acf.groupBy(*spec.keys, "lag").agg(pick("logret_1").alias("acf_r"), pick("squared").alias("acf_r2"))


def gap_calendar(bars: DataFrame, spec: SeriesSpec, top: int = 15) -> DataFrame:
    """Month-days that most often end a long gap which is not a weekend of any length."""
    gaps = gap_counts(bars, spec).where(~weekend(spec.ts))
    counted = gaps.groupBy(F.month(spec.ts).alias("month"), F.dayofmonth(spec.ts).alias("day"))
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "month", "day").limit(top)


def source_coverage(external: DataFrame) -> DataFrame:
    return external.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("value_date").alias("first_date"), F.max("value_date").alias("last_date")
    )


def fill_rates(aligned: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Filled rows, all rows and percentage per aligned source."""
    counts = aligned.agg(F.count(F.lit(1)).alias("total"), *[F.count(s).alias(s) for s in sources])
    return counts.unpivot(["total"], list(sources), "source", "filled").select(
        "source", "filled", "total", (F.col("filled") / F.col("total") * 100.0).alias("pct")
    )


def return_histogram(bars: DataFrame, spec: SeriesSpec, bins: int = 200) -> DataFrame:
    return histogram(bar_returns(bars, spec), spec.keys, "r", bins)


def qq_points(bars: DataFrame, spec: SeriesSpec, points: int = 99) -> DataFrame:
    """Return quantiles against standard normal quantiles on an even grid of probabilities."""
    grid = [i / (points + 1) for i in range(1, points + 1)]
    normal = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("z")) for p in grid])
    q = exact_quantiles(bar_returns(bars, spec), spec.keys, "r", grid)
    z = F.element_at(F.map_from_entries(normal), F.col("p"))
    return q.select(*spec.keys, "p", z.alias("normal_q"), F.col("q").alias("return_q"))


def target_correlation(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Correlation of every feature with the target, in one aggregate."""
    wide = df.groupBy(*keys).agg(*[pearson(c, target).alias(c) for c in features])
    return wide.unpivot(list(keys), list(features), "feature", "corr")


def feature_correlation(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Pairwise-complete correlation of all feature pairs ``(left < right by position)``.

    Tasks reduce their rows to Gram matrices, which Spark adds up; the frame is read once and
    never paired with itself. Columns are standardised first to keep the sums stable.
    """
    names, group = list(features), list(keys)
    stats = [f(c).alias(f"_{t}{i}") for i, c in enumerate(names) for t, f in (("m", F.avg), ("s", F.stddev_pop))]
    # constant columns turn NULL here and stay without a correlation
    centred = df.join(df.groupBy(*group).agg(*stats), group).select(
        *group, *[F.try_divide(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}")).alias(c) for i, c in enumerate(names)]
    )
    upper = np.triu_indices(len(names), 1)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(group, dropna=False) if group else [((), batch)]:
                x = part[names].to_numpy(dtype="float64")
                seen = (~np.isnan(x)).astype("float64")
                x = np.nan_to_num(x)
                stats = np.stack([seen.T @ seen, x.T @ seen, seen.T @ x, (x * x).T @ seen, seen.T @ (x * x), x.T @ x])
                sums[key] = sums[key] + stats if key in sums else stats
        for key, stats in sums.items():
            cells = [s[upper] for s in stats]
            frame = pd.DataFrame(dict(zip(("n", "sx", "sy", "sxx", "syy", "sxy"), cells, strict=True)))
            for name, value in zip(group, key, strict=True):
                frame.insert(0, name, value)
            frame["left"] = np.array(names, dtype=object)[upper[0]]
            frame["right"] = np.array(names, dtype=object)[upper[1]]
            yield frame[[*group, "left", "right", "n", "sx", "sy", "sxx", "syy", "sxy"]]

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"`{k}` {types[k]}, " for k in group)
    parts = centred.mapInPandas(
        grams, head + "left string, right string, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    total = parts.groupBy(*group, "left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, zero = F.col("n"), F.lit(0.0)
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = F.greatest(n * F.col("sxx") - F.col("sx") * F.col("sx"), zero)
    vy = F.greatest(n * F.col("syy") - F.col("sy") * F.col("sy"), zero)
    return total.select(*group, "left", "right", F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)).alias("corr"))


def binned_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mutual information (nats) of quantile-binned features and target over complete rows.

    Class labels work as they are: repeated quantiles merge, which leaves one bin per label.
    """
    if not keys:
        # a constant key keeps the lookup of the edges an ordinary join with one row
        whole = binned_information(df.withColumn("_all", F.lit(0)), features, target, bins, ["_all"])
        return whole.drop("_all")
    known = df.dropna(subset=[*features, target])
    columns = [*features, target]
    probs = [i / bins for i in range(1, bins)]
    edges = (
        exact_quantiles(to_long(known, keys, columns), [*keys, "feature"], "value", probs)
        .groupBy(*keys, "feature")
        .agg(F.array_sort(F.collect_list("q")).alias("edges"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("edges"))
    )
    rows = known.join(edges, list(keys))

    def bin_of(c: str):
        return F.size(F.filter(F.element_at("edges", F.lit(c)), lambda e: e < F.col(c)))

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bx")) for c in features])
    joint = (
        rows.select(*keys, F.explode(cells).alias("x"), bin_of(target).alias("by"))
        .groupBy(*keys, F.col("x.feature").alias("feature"), F.col("x.bx").alias("bx"), "by")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = [*keys, "feature"]
    px = joint.groupBy(*group, "bx").agg(F.sum("n").alias("nx"))
    py = joint.groupBy(*group, "by").agg(F.sum("n").alias("ny"))
    al = joint.groupBy(*group).agg(F.sum("n").alias("na"))
    p = joint.join(px, [*group, "bx"]).join(py, [*group, "by"]).join(al, group)
    n, nx, ny, na = (F.col(c).cast("double") for c in ("n", "nx", "ny", "na"))
    return p.groupBy(*group).agg(F.sum(n / na * F.ln(n * na / (nx * ny))).alias("mi"))
