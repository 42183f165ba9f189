"""Look-ahead audits of the feature table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.blocks import ROW, ROWS, Blocked, SeriesSpec, index_rows
from tidegauge.session import materialise


def truncated_copies(bars: DataFrame, spec: SeriesSpec, cuts: Sequence[float]) -> DataFrame:
    """A copy of every series per cut that ends at the cut and knows nothing of its last bar.

    Cuts are shares of the series length. The last bar keeps its time, but its values are
    NULL: a feature that needs them cannot come out right.
    """
    last = F.floor(F.col(ROWS) * F.col("_share")).cast("bigint")
    copies = (
        index_rows(bars, spec)
        .withColumn("_share", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
        .where(F.col(ROW) <= last)
        .withColumn("cut", F.col("_share"))
    )
    hidden = [c for c in bars.columns if c not in (*spec.keys, spec.ts)]
    blank = {c: F.when(F.col(ROW) < last, F.col(c)) for c in hidden}
    return copies.withColumns({**blank, "is_cut": F.col(ROW) == last}).drop("_share", ROW, ROWS)


def leakage_audit(
    bars: DataFrame,
    build: Callable[[DataFrame, SeriesSpec], DataFrame],
    features: Sequence[str],
    spec: SeriesSpec,
    cuts: Sequence[float] = (0.35, 0.6, 0.85),
    tolerance: float = 1e-9,
) -> DataFrame:
    """``(keys, feature, checked, mismatches)``: features at each cut against the full series."""
    bars = bars.select(*spec.keys, spec.ts, *[c for c in bars.columns if c not in (*spec.keys, spec.ts)])
    copies = materialise(truncated_copies(bars, spec, cuts))
    at_cut = copies.where("is_cut").select(*spec.keys, "cut", spec.ts)
    cut_spec = spec.with_keys(*spec.keys, "cut")
    again = build(copies.drop("is_cut"), cut_spec).join(at_cut, [*spec.keys, "cut", spec.ts], "left_semi")
    pairs = again.select(*spec.keys, "cut", spec.ts, *[F.col(c).alias(f"_a_{c}") for c in features]).join(
        build(bars, spec).select(*spec.keys, spec.ts, *features), [*spec.keys, spec.ts]
    )
    return _compare(pairs, spec.keys, features, tolerance)


#: the copy that keeps its values
UNTOUCHED = -1


def perturbed_copies(bars: DataFrame, spec: SeriesSpec, cuts: Sequence[float]) -> DataFrame:
    """Every series once as it is (``cut`` -1) and once per cut with all values from the cut row on changed.

    Cuts are shares of the series length, given back as row numbers in ``cut``. A row's
    values are multiplied by one factor between 1.05 and 1.15, drawn from a hash of its key,
    time and cut, so bars keep their order of prices and reruns agree. Missing values become the factor.
    """
    values = [c for c in bars.columns if c not in (*spec.keys, spec.ts)]
    rows = index_rows(bars, spec)
    at = F.array(F.lit(UNTOUCHED).cast("bigint"), *[F.floor(F.col(ROWS) * F.lit(float(c))).cast("bigint") for c in cuts])
    copies = rows.withColumn("cut", F.explode(F.array_distinct(at)))
    draw = F.pmod(F.xxhash64(*spec.keys, F.col(spec.ts).cast("timestamp"), "cut"), F.lit(1000)) / 1000.0
    changed = (F.col("cut") != UNTOUCHED) & (F.col(ROW) >= F.col("cut"))
    copies = copies.withColumn("_factor", F.when(changed, 1.05 + 0.1 * draw))
    moved = {c: F.when(changed, F.coalesce(F.col(c) * F.col("_factor"), F.col("_factor"))).otherwise(F.col(c)) for c in values}
    return copies.withColumns(moved).drop("_factor", ROWS)


def perturbation_audit(
    bars: DataFrame,
    build: Callable[[DataFrame, SeriesSpec], DataFrame],
    features: Sequence[str],
    spec: SeriesSpec,
    cuts: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 0.95),
    tolerance: float = 1e-9,
) -> DataFrame:
    """``(keys, feature, checked, mismatches)``: every row up to each cut, with and without another future.

    A feature that knows only bars before its own comes out alike at all rows up to the cut
    row itself. All copies go through one build. ``bars`` are read more than once.
    """
    keys, cut_spec = list(spec.keys), spec.with_keys(*spec.keys, "cut")
    copies = materialise(perturbed_copies(bars, spec, cuts))
    built = materialise(build(copies.drop(ROW), cut_spec).select(*keys, "cut", spec.ts, *features))
    left = copies.where((F.col("cut") != UNTOUCHED) & (F.col(ROW) <= F.col("cut"))).select(*keys, "cut", spec.ts)
    again = built.join(left, [*keys, "cut", spec.ts], "left_semi").withColumnsRenamed({c: f"_a_{c}" for c in features})
    pairs = again.join(built.where(F.col("cut") == UNTOUCHED).drop("cut"), [*keys, spec.ts])
    return _compare(pairs, keys, features, tolerance)


def _compare(pairs: DataFrame, keys: Sequence[str], features: Sequence[str], tolerance: float) -> DataFrame:
    """Rows and differing rows of every feature ``c`` against ``_a_<c>``."""

    def differs(c: str):
        a, b = F.col(f"_a_{c}"), F.col(c)
        close = F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1.0))
        return ~(a.isNull() & b.isNull()) & ~F.coalesce(close, F.lit(False))

    wide = pairs.groupBy(*keys).agg(
        *[F.struct(F.count(F.lit(1)).alias("checked"), F.count_if(differs(c)).alias("mismatches")).alias(c) for c in features]
    )
    return wide.unpivot(list(keys), list(features), "feature", "s").select(*keys, "feature", "s.checked", "s.mismatches")


def target_audit(table: DataFrame, spec: SeriesSpec, target: str, horizon: int, tolerance: float = 1e-12) -> DataFrame:
    """Rows per series whose stored target differs from the close ``horizon`` rows later."""
    b = Blocked.of(table.select(*spec.keys, ROW, ROWS, "close", target), spec, back=0, ahead=horizon)
    rows = b.run([{"_later": b.lead("close", horizon)}]).home()
    off = F.abs(F.ln(F.try_divide(F.col("_later"), F.col("close"))) - F.col(target)) > tolerance
    return rows.groupBy(*spec.keys).agg(
        F.count(target).alias("checked"),
        F.count_if(off | (F.col(target).isNull() != F.col("_later").isNull())).alias("mismatches"),
    )
