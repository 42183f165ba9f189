"""The three stages of a build as jobs over stored tables: align, features, splits.

Every stage reads the tables of the stage before it under one root folder and writes its
own, so a stage can be repeated alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.evaluation import profile as pf
from tidegauge.operators.asof import align_sources
from tidegauge.operators.blocks import ROW, ROWS, SeriesSpec
from tidegauge.operators.scaling import apply_scaler, fit_scaler
from tidegauge.operators.sequences import sequence_windows
from tidegauge.operators.splits import ORDER, chronological_split, excluded_series, summarise_rows, walk_forward
from tidegauge.operators.validate import issue_summary, raise_if_errors, validation_report
from tidegauge.plans.features import FeatureConfig, feature_matrix, feature_names
from tidegauge.session import materialise
from tidegauge.sources.writers import write_scaler, write_sequences, write_summary, write_table


@dataclass(frozen=True)
class BuildConfig:
    root: str
    spec: SeriesSpec = SeriesSpec()
    features: FeatureConfig = field(default_factory=FeatureConfig)
    train: float = 0.70
    val: float = 0.15
    test: float = 0.15
    embargo: int = 24
    folds: int = 5
    #: what to do with series too short for the split: ``raise`` or ``exclude``
    short: str = "raise"

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def _side_by_side(*single_rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    keyed = [df.withColumn("_one", F.lit(1)) for df in single_rows]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def run_align(bars: DataFrame, external: DataFrame, sources: Sequence[str], config: BuildConfig, strict: bool = False) -> DataFrame:
    """Store bars, check them, align the externals; returns the summary it stores."""
    spark, spec = bars.sparkSession, config.spec
    stored = spark.read.parquet(write_table(bars, config.path("bars")))
    issues = materialise(validation_report(stored, spec))
    write_table(issues, config.path("issues"))
    if strict:
        raise_if_errors(issues)
    aligned = spark.read.parquet(
        write_table(align_sources(stored, external, sources, spec), config.path("aligned"), spec.keys)
    )
    rates = pf.fill_rates(aligned, sources).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "pct")))).alias("fill_pct")
    )
    span = aligned.agg(
        F.count(F.lit(1)).alias("rows"), F.min(spec.ts).alias("start_ts"), F.max(spec.ts).alias("end_ts")
    )
    summary = materialise(_side_by_side(span, rates, issue_summary(issues)))
    write_summary(summary, config.path("align_summary"))
    return summary


def feature_summary(table: DataFrame, spec: SeriesSpec, config: FeatureConfig) -> DataFrame:
    """One row: size, names, the largest gap rates, class balance and target moments."""
    names = feature_names(table.columns, spec, config)
    y_reg, y_clf, _ = config.targets
    gaps = pf.null_rates(table, names).agg(F.collect_list(F.struct("column", "rate")).alias("top_null_rates"))
    balance = pf.class_balance(table, y_clf, ()).agg(
        F.array_sort(F.collect_list(F.struct(F.col(y_clf).alias("label"), "n"))).alias("class_balance")
    )
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.avg(y_reg).alias("_m"), F.stddev_samp(y_reg).alias("_s")).select(
        "rows",
        F.lit(len(names)).alias("n_features"),
        F.array(*[F.lit(n) for n in names]).alias("feature_names"),
        F.round(F.col("_m") * 1e4, 4).alias("y_reg_mean_bp"),
        F.round(F.col("_s") * 1e4, 4).alias("y_reg_std_bp"),
    )
    return _side_by_side(size, gaps, balance)


def run_features(spark: SparkSession, config: BuildConfig) -> DataFrame:
    """Feature and target table from the aligned bars; returns the summary it stores."""
    aligned = spark.read.parquet(config.path("aligned"))
    built = feature_matrix(aligned, config.spec, config.features)
    table = spark.read.parquet(write_table(built, config.path("features"), config.spec.keys))
    summary = materialise(feature_summary(table, config.spec, config.features))
    write_summary(summary, config.path("feature_summary"))
    return summary


def run_splits(spark: SparkSession, config: BuildConfig) -> DataFrame:
    """Scaled tabular and sequence datasets per split, scaler, fold table; returns the split summary.

    The scaler sees train rows only. Tabular rows keep their gaps; sequences get 0, the
    scaled mean, and reach back over split borders.
    """
    spec, lookback = config.spec, config.features.lookback
    table = spark.read.parquet(config.path("features"))
    names = feature_names(table.columns, spec, config.features)
    y_reg, y_clf, _ = config.features.targets
    parts = {"train": config.train, "val": config.val, "test": config.test, "embargo": config.embargo}
    rows = chronological_split(table, **parts, short=config.short)
    if config.short == "exclude":
        write_table(excluded_series(table, spec.keys, **parts), config.path("excluded_series"))
    scaler = spark.read.parquet(
        write_scaler(fit_scaler(rows.where("split = 'train'"), names, spec.keys), config.path("scaler"))
    )
    head = [*spec.keys, spec.ts, "split"]
    tabular = apply_scaler(rows, scaler, names, spec.keys).where(F.col("split").isNotNull())
    write_table(tabular.select(*head, *names, y_reg, y_clf, "close"), config.path("tabular"), ["split"])
    filled = apply_scaler(rows, scaler, names, spec.keys, fill=0.0)
    filled = filled.select(*head, ROW, ROWS, *names, y_reg, y_clf)
    windows = sequence_windows(filled, spec, names, ["split", y_reg, y_clf], y_reg, lookback)
    write_sequences(windows.where(F.col("split").isin(*ORDER)), config.path("sequences"))
    folds = walk_forward(table, config.folds, config.embargo, short=config.short)
    write_summary(summarise_rows(folds, [*spec.keys, "fold", "role"], spec.ts), config.path("fold_summary"))
    summary = summarise_rows(rows.where(F.col("split").isNotNull()), [*spec.keys, "split"], spec.ts)
    write_summary(summary, config.path("split_summary"))
    return summary
