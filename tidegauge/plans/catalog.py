"""Registered queries: every operator over the whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.evaluation import diagnostics as dg
from tidegauge.evaluation import metrics as mt
from tidegauge.evaluation import profile as pf
from tidegauge.functions import technical as ta
from tidegauge.functions.calendar import CALENDAR, calendar_columns
from tidegauge.functions.external import macro_names, macro_stages, sentiment_names, sentiment_stages
from tidegauge.functions.target import regression_target, target_stages, threshold
from tidegauge.models import baselines as bl
from tidegauge.models.naive import AutoRegression, MajorityClass, ZeroForecast
from tidegauge.models.training import evaluate, learning_curve, read_runs, split_metrics, train_and_evaluate
from tidegauge.models.trees import BoostedTrees, RandomForest
from tidegauge.models.tuning import tune
from tidegauge.operators import scaling as sc
from tidegauge.operators import sequences as sq
from tidegauge.operators import splits as sp
from tidegauge.operators import validate as va
from tidegauge.operators.asof import align_grid, align_intervals, align_sources, asof_keyed
from tidegauge.operators.blocks import ROW, ROWS, Blocked, index_rows
from tidegauge.operators.ewm import Ewm, ewm_means
from tidegauge.operators.intervals import interval_join
from tidegauge.operators.ordered import wide_quantiles
from tidegauge.operators.window_store import map_windows, write_window_store
from tidegauge.plans import testbed as tb
from tidegauge.plans.audit import leakage_audit, perturbation_audit, target_audit
from tidegauge.plans.features import FeatureConfig, aligned_bars, feature_matrix, feature_names
from tidegauge.session import materialise
from tidegauge.sources.readers import BAR_HEADER, keywords_long, sift_bars_csv
from tidegauge.streaming.revisions import LATE, latest_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: columns of the feature table, the inputs of the dataset and model queries
FEATURES = tuple(
    sorted(
        (
            *ta.TECHNICAL, *macro_names(["dxy", "us10y_yield", "vix", "order_flow"]),
            "fear_greed_level", "fear_greed_ma24_to_level", "fear_greed_z168", *CALENDAR,
        )
    )
)
#: all features of the feature table, by the names it has before it is shown
AUDITED = (
    *ta.TECHNICAL, *macro_names(["dxy", "us10y_yield", "vix", "order_flow"]), *sentiment_names(["fear_greed"]), *CALENDAR,
)
H = 24


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round double columns and turn -0.0 into 0.0, so that engines agree on the value."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _bank(spark: SparkSession, sf_dir: str, back: int, *make) -> DataFrame:
    """Daily bars with the stages of some indicators."""
    b = Blocked.of(tb.daily_index(spark, sf_dir), tb.DAILY, back=back)
    return b.run(*[m(b) for m in make]).home()


def _show(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return rounded(df.select("symbol", "ts", *columns), digits, *columns)


# --- bars and externals -----------------------------------------------------------------


@register
def ohlcv_bars(spark, d):
    return tb.hourly_bars(spark, d)


@register
def bar_revisions(spark, d):
    """Bars of ticks that arrive out of order, as of their last revision."""
    bars = latest_bars(tb.replayed_bars(spark, d))
    return bars.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register
def late_ticks(spark, d):
    """Ticks that the stream of revised bars refused."""
    late = tb.replayed_bars(spark, d).where(F.col("kind") == LATE)
    return late.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("tick_order").cast("long").alias("event_id"), "price")


@register
def daily_bars(spark, d):
    return tb.daily_bars(spark, d)


def _landed_bars(spark, d):
    """Daily bars as CSV files per series, in local times, with faults by day of month; then sifted."""
    bars, day = tb.daily_bars(spark, d), F.dayofmonth("ts")
    zone = "America/New_York"
    local = F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd HH:mm:ss")
    text = {c: F.col(c.lower()).cast("string") for c in BAR_HEADER[1:]}
    text["Close"] = F.when(day == 6, "n/a").otherwise(text["Close"])
    text["Volume"] = F.when(day != 7, text["Volume"])
    stamp = F.when(day == 5, "not a time").when(day == 8, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'Z'")).otherwise(local)
    rows = bars.select("symbol", stamp.alias("Datetime"), *[v.alias(c) for c, v in text.items()])
    folder = f"{spark.sparkContext.getCheckpointDir()}/bars-{uuid.uuid4().hex}"
    rows.write.option("header", True).partitionBy("symbol").csv(folder)
    return sift_bars_csv(spark, folder, F.regexp_extract("_metadata.file_path", r"symbol=([^/]+)", 1), zone)


@register
def csv_bars(spark, d):
    """The readable bars of CSV files."""
    return _landed_bars(spark, d)[0]


@register
def csv_rejected(spark, d):
    """Lines of CSV files that are no bars, counted by reason."""
    return _landed_bars(spark, d)[1].groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("n"))


@register
def release_dates(spark, d):
    return tb.external(spark, d)


@register
def keyword_long(spark, d):
    names = {f"trend_{i}": p for i, p in enumerate(tb.SOURCE_OF)}
    wide = tb.table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("date")).agg(
        *[F.count_if(F.col("o_orderpriority") == p).alias(k) for k, p in names.items()]
    )
    return keywords_long(wide, list(names))


@register
def source_coverage(spark, d):
    return pf.source_coverage(tb.external(spark, d))


@register
def asof_align(spark, d):
    return align_grid(materialise(tb.daily_bars(spark, d).select("ts")), tb.external(spark, d), tb.SOURCES, tb.DAILY)


@register
def asof_multi(spark, d):
    bars = tb.stored_daily(spark, d).select("symbol", "ts", "close")
    return align_sources(bars, tb.external(spark, d), tb.SOURCES, tb.DAILY)


@register
def asof_interval(spark, d):
    return align_intervals(tb.stored_daily(spark, d).select("ts"), tb.external(spark, d), tb.DAILY)


def _last_purchase(spark, d, user):
    events = tb.table(spark, d, "events").withColumn("user_key", user)
    bought = events.where("event_type = 'purchase'")
    bought = bought.select("user_key", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase_id"), F.col("value").alias("paid"))
    other = events.where("event_type <> 'purchase'").select("event_id", "user_key", "ts")
    return asof_keyed(other, bought, ["user_key"], "ts", "bought_at", ["purchase_id", "paid"])


@register
def asof_keyed_users(spark, d):
    """Every other event with its user's latest purchase before it."""
    return _last_purchase(spark, d, F.col("user_id"))


@register
def asof_keyed_hot(spark, d):
    """The same with a third of all users under one key."""
    return _last_purchase(spark, d, F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))


@register
def interval_activity(spark, d):
    """Users between their first and last event at every hour of the bars."""
    spans = tb.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    pairs = interval_join(tb.hourly_bars(spark, d).select("ts"), spans, "ts", "first_ts", "last_ts", ["user_id"])
    return pairs.groupBy("ts").agg(F.count(F.lit(1)).alias("n_active"), F.sum("user_id").alias("id_sum"))


@register
def align_fill_rate(spark, d):
    aligned = align_sources(tb.stored_daily(spark, d).select("symbol", "ts"), tb.external(spark, d), tb.SOURCES, tb.DAILY)
    return rounded(pf.fill_rates(aligned, tb.SOURCES), 6, "pct")


# --- window primitives --------------------------------------------------------------------


@register
def log_returns(spark, d):
    names = [f"logret_{k}" for k in (1, 4, 24, 168)]
    return _show(_bank(spark, d, 168, lambda b: ta.log_returns(b, (1, 4, 24, 168))), 9, *names)


@register
def feature_lag(spark, d):
    rows = _bank(spark, d, 2, lambda b: [*ta.log_returns(b, (1,)), {"lagged": b.lag("logret_1", 1)}])
    return _show(rows, 9, "logret_1", "lagged")


@register
def rolling_stats(spark, d):
    """24-bar mean relative to the close, deviation of returns and its day-scaled form."""

    def stages(b):
        return [
            *ta.log_returns(b, (1,)),
            {"mean_rel": F.try_divide(b.mean("close", 24), F.col("close")), "std_24": b.std("logret_1", 24)},
            {"std_scaled": F.col("std_24") * F.sqrt(F.lit(24.0))},
        ]

    return _show(_bank(spark, d, 25, stages), 7, "mean_rel", "std_24", "std_scaled")


@register
def rolling_extrema(spark, d):
    rows = _bank(spark, d, 20, lambda b: [{"low_14": b.min("low", 14), "high_14": b.max("high", 14)}])
    return rows.select("symbol", "ts", "low_14", "high_14")


@register
def rolling_zscore(spark, d):
    return _show(_bank(spark, d, 168, lambda b: ta.close_zscore(b, (24, 168))), 6, "zscore_24", "zscore_168")


@register
def bar_gaps(spark, d):
    return rounded(va.bar_gaps(tb.stored_hourly(spark, d), tb.HOURLY), 6, "gap_hours")


@register
def ema(spark, d):
    rows = materialise(tb.daily_index(spark, d).select("symbol", "ts", ROW, "close"))
    means = {"ema_12": Ewm.of_span("close", 12), "wilder_14": Ewm("close", 1 / 14, 14)}
    return _show(ewm_means(rows, tb.DAILY, means), 2, *means)


@register
def ema_short(spark, d):
    """Means too short for one scan block."""
    rows = materialise(tb.daily_index(spark, d).select("symbol", "ts", ROW, "close"))
    means = {f"ema_{n}": Ewm.of_span("close", n) for n in (2, 3, 5)}
    return _show(ewm_means(rows, tb.DAILY, means), 2, *means)


@register
def tabular_rolling(spark, d):
    rows = materialise(_bank(spark, d, 5, lambda b: ta.log_returns(b, (1, 4)), lambda b: [{"y": F.col("close")}]))
    rows = rows.withColumn("logret_4", F.coalesce("logret_4", F.lit(0.0))).withColumn("logret_1", F.coalesce("logret_1", F.lit(0.0)))
    out = sq.tabular_windows(rows, tb.DAILY, ["logret_1", "logret_4"], "y", 24, sq.ROLLING)
    return rounded(out.drop("y"), 7, *[c for c in out.columns if c.startswith("logret")])


@register
def acf(spark, d):
    return rounded(pf.autocorrelation(tb.stored_daily(spark, d), tb.DAILY), 8, "acf_r", "acf_r2")


# --- indicators ---------------------------------------------------------------------------


@register
def realized_vol(spark, d):
    return _show(_bank(spark, d, 170, lambda b: ta.realized_volatility(b, (24, 168))), 8, "rv_24", "rv_168")


@register
def roc(spark, d):
    return _show(_bank(spark, d, 10, ta.rate_of_change), 6, "roc_10")


@register
def williams_r(spark, d):
    return _show(_bank(spark, d, 14, ta.williams_r), 8, "willr_14")


@register
def stochastic(spark, d):
    return _show(_bank(spark, d, 16, ta.stochastic), 8, "stoch_k", "stoch_d")


@register
def cci(spark, d):
    return _show(_bank(spark, d, 40, ta.cci), 6, "cci_20")


@register
def bollinger(spark, d):
    rows = _bank(spark, d, 20, ta.bollinger).select("symbol", "ts", "bb_upper", "bb_lower", "bb_pctb", "bb_bw")
    return rounded(rounded(rows, 3, "bb_upper", "bb_lower"), 7, "bb_pctb", "bb_bw")


def _smoothed(spark, d, reach, *make):
    return materialise(_bank(spark, d, reach, *make))


@register
def rsi(spark, d):
    rows = ewm_means(_smoothed(spark, d, 1, ta.momentum_inputs), tb.DAILY, ta.rsi_means())
    return _show(ta.finish_rsi(rows), 6, "rsi_14")


@register
def macd(spark, d):
    rows = materialise(tb.daily_index(spark, d).select("symbol", "ts", ROW, "close"))
    rows = ewm_means(rows, tb.DAILY, ta.macd_means()).withColumn("macd_line", F.col("_ef") - F.col("_es"))
    rows = ewm_means(rows, tb.DAILY, {"macd_signal": Ewm.of_span("macd_line", 9)})
    rows = rows.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))
    return _show(rows, 2, "macd_line", "macd_signal", "macd_hist")


@register
def atr(spark, d):
    wanted = {"atr_14": Ewm("_tr", 1 / 14, 14)}
    return _show(ewm_means(_smoothed(spark, d, 1, ta.range_inputs), tb.DAILY, wanted), 3, "atr_14")


@register
def adx(spark, d):
    rows = ewm_means(_smoothed(spark, d, 1, ta.range_inputs), tb.DAILY, ta.range_means())
    rows = ewm_means(ta.directional_index(rows), tb.DAILY, {"adx_14": Ewm("_dx", 1 / 14, 14)})
    return _show(rows, 6, "adx_14")


PRICE_LEVEL = ("macd_line", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "atr_14")


def _round_bank(df: DataFrame) -> DataFrame:
    df = rounded(df, 2, *[c for c in PRICE_LEVEL if c in df.columns])
    return rounded(df, 6, *[c for c in ta.TECHNICAL if c in df.columns and c not in PRICE_LEVEL])


@register
def technical_features(spark, d):
    b = Blocked.of(tb.daily_index(spark, d), tb.DAILY, back=ta.BANK_REACH + 1)
    rows = materialise(b.run(ta.technical_stages(b, 1)).home())
    return _round_bank(ta.smoothed_columns(rows, tb.DAILY).select("symbol", "ts", *ta.TECHNICAL))


# --- macro, sentiment, calendar, targets ----------------------------------------------------


def _aligned_index(spark, d):
    aligned = aligned_bars(tb.stored_daily(spark, d).drop("n_ticks"), tb.external(spark, d), tb.SOURCES, tb.DAILY)
    return index_rows(aligned, tb.DAILY)


@register
def macro_features(spark, d):
    b = Blocked.of(_aligned_index(spark, d), tb.DAILY, back=170)
    names = ["dxy", "us10y_yield", "vix", "order_flow"]
    return _show(b.run(macro_stages(b, names)).home(), 6, *macro_names(names))


@register
def sentiment_features(spark, d):
    b = Blocked.of(_aligned_index(spark, d), tb.DAILY, back=170)
    rows = b.run(sentiment_stages(b, ["fear_greed"])).home()
    # the mean relative to the level has no ties at the rounding digit
    rows = rows.withColumn("fear_greed_ma24_to_level", F.try_divide(F.col("fear_greed_ma24"), F.col("fear_greed_level")))
    return _show(rows, 6, "fear_greed_level", "fear_greed_ma24_to_level", "fear_greed_z168")


@register
def calendar_features(spark, d):
    rows = tb.hourly_bars(spark, d).select("symbol", "ts").withColumns(calendar_columns())
    return rounded(rows.select("symbol", "ts", *CALENDAR), 9, *CALENDAR[:6])


@register
def target_reg(spark, d):
    b = Blocked.of(tb.daily_index(spark, d), tb.DAILY, back=0, ahead=H)
    return _show(b.run(regression_target(b, H)).home(), 9, "y_reg_h24")


@register
def target_threshold(spark, d):
    b = Blocked.of(tb.daily_index(spark, d), tb.DAILY, back=26)
    return _show(b.run(threshold(b, H)).home(), 8, "rv_past_24", "y_clf_threshold")


def _targets(spark, d):
    b = Blocked.of(tb.daily_index(spark, d), tb.DAILY, back=26, ahead=H)
    return b.run(target_stages(b, H)).home()


@register
def target_clf(spark, d):
    return _targets(spark, d).select("symbol", "ts", "y_clf_h24")


@register
def target_rows(spark, d):
    rows = _targets(spark, d).where(F.col("y_reg_h24").isNotNull() & F.col("y_clf_h24").isNotNull())
    return rounded(rows.select("symbol", "ts", "y_reg_h24", "y_clf_h24"), 9, "y_reg_h24")


@register
def warmup_cut(spark, d):
    return tb.daily_index(spark, d).where(F.col(ROW) >= 200).select("symbol", "ts", "close")


def _matrix(spark, d):
    aligned = aligned_bars(tb.stored_daily(spark, d).drop("n_ticks"), tb.external(spark, d), tb.SOURCES, tb.DAILY)
    return feature_matrix(aligned, tb.DAILY)


@register
def feature_matrix_full(spark, d):
    table = _matrix(spark, d)
    names = feature_names(table.columns, tb.DAILY, FeatureConfig())
    # shown relative to the level, as in sentiment_features
    table = table.withColumn("fear_greed_ma24", F.try_divide(F.col("fear_greed_ma24"), F.col("fear_greed_level")))
    table = table.withColumnRenamed("fear_greed_ma24", "fear_greed_ma24_to_level")
    names = [c.replace("fear_greed_ma24", "fear_greed_ma24_to_level") for c in names]
    table = _round_bank(table)
    other = [c for c in names if c not in ta.TECHNICAL and c not in CALENDAR]
    table = rounded(rounded(table, 6, *other, "y_reg_h24", "y_clf_threshold"), 9, *CALENDAR[:6])
    return table.drop(ROW, ROWS)


# --- validation -----------------------------------------------------------------------------


@register
def dup_check(spark, d):
    ticks = tb.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "symbol")
    return va.duplicate_counts(ticks, ["l_orderkey", "l_linenumber"])


@register
def order_check(spark, d):
    orders = tb.table(spark, d, "orders")
    return va.order_violations(orders, "o_orderkey", "o_orderdate", "o_orderpriority", span=1024)


@register
def ohlc_check(spark, d):
    return va.ohlc_violations(tb.damaged_bars(spark, d))


@register
def null_counts(spark, d):
    return va.null_counts(tb.damaged_bars(spark, d), va.PRICES)


@register
def gap_check(spark, d):
    gaps = va.gap_counts(tb.stored_hourly(spark, d), tb.HOURLY, weekday_hours=1)
    return gaps.groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"), F.max("gap_hours").alias("longest"))


@register
def volume_check(spark, d):
    bars = tb.daily_bars(spark, d)
    flat = bars.unionByName(bars.withColumns({"symbol": F.concat("symbol", F.lit("_flat")), "volume": F.lit(0.0)}))
    return va.check_volume(flat).select("symbol", "severity", "code")


@register
def validation_report(spark, d):
    issues = va.validation_report(materialise(tb.damaged_bars(spark, d)), tb.DAILY)
    return issues.select("symbol", "severity", "code", "n")


@register
def issue_summary(spark, d):
    return va.issue_summary(va.validation_report(materialise(tb.damaged_bars(spark, d)), tb.DAILY), ["symbol"])


# --- profile --------------------------------------------------------------------------------


@register
def series_summary(spark, d):
    return rounded(pf.series_summary(tb.stored_hourly(spark, d), tb.HOURLY), 6, "span_years", "median_return_pct")


def _feature_rows(spark, d):
    """The feature table at its shown precision, indexed and stored once."""
    table = materialise(feature_matrix_full(spark, d))
    rows = table.select("symbol", "ts", "close", *FEATURES, "y_reg_h24", "y_clf_h24")
    return materialise(index_rows(rows, tb.DAILY))


@register
def null_rates(spark, d):
    rows = _feature_rows(spark, d)
    return rounded(pf.null_rates(rows, [*FEATURES, "y_reg_h24", "y_clf_h24"]), 9, "rate")


@register
def class_balance(spark, d):
    return pf.class_balance(_targets(spark, d), "y_clf_h24")


@register
def target_stats(spark, d):
    return rounded(pf.target_stats(_targets(spark, d), "y_reg_h24"), 5, "mean_bp", "std_bp")


@register
def describe_bars(spark, d):
    out = pf.describe(tb.stored_hourly(spark, d), ["open", "high", "low", "close"])
    out = out.withColumn("mean", F.ln("mean")).withColumnRenamed("mean", "log_mean")  # the mean of cents has ties at any rounding digit
    return rounded(out, 6, "log_mean", "std", "q25", "q50", "q75")


@register
def return_moments(spark, d):
    return rounded(pf.return_moments(tb.stored_daily(spark, d), tb.DAILY), 5, "mean_bp", "std_bp", "skew", "kurt")


@register
def hourly_volatility(spark, d):
    return rounded(pf.hourly_volatility(tb.stored_hourly(spark, d), tb.HOURLY), 7, "mean_abs_pct")


@register
def gap_calendar(spark, d):
    return pf.gap_calendar(tb.stored_hourly(spark, d), tb.HOURLY)


@register
def feature_quartiles(spark, d):
    """Quartiles of every feature of every series."""
    out = wide_quantiles(_feature_rows(spark, d), ["symbol"], FEATURES, [0.25, 0.5, 0.75])
    return rounded(out, 7, "q")


@register
def feature_corr(spark, d):
    return rounded(pf.feature_correlation(_feature_rows(spark, d), FEATURES), 6, "corr")


@register
def target_corr(spark, d):
    return rounded(pf.target_correlation(_feature_rows(spark, d), FEATURES, "y_reg_h24"), 6, "corr")


@register
def binned_mi(spark, d):
    rows = _feature_rows(spark, d)
    reg = pf.binned_information(rows, FEATURES, "y_reg_h24", keys=["symbol"]).withColumn("target", F.lit("y_reg_h24"))
    clf = pf.binned_information(rows, FEATURES, "y_clf_h24", keys=["symbol"]).withColumn("target", F.lit("y_clf_h24"))
    return rounded(reg.unionByName(clf), 8, "mi")


@register
def return_hist(spark, d):
    return rounded(pf.return_histogram(tb.stored_daily(spark, d), tb.DAILY), 8, "left_edge", "density")


@register
def qq_points(spark, d):
    return rounded(pf.qq_points(tb.stored_daily(spark, d), tb.DAILY), 8, "normal_q", "return_q")


# --- splits and datasets ----------------------------------------------------------------------


@register
def chrono_split(spark, d):
    rows = sp.chronological_split(tb.daily_index(spark, d))
    return rows.where(F.col("split").isNotNull()).select("symbol", "ts", "split", "split_row")


@register
def split_summary(spark, d):
    rows = sp.chronological_split(tb.daily_index(spark, d)).where(F.col("split").isNotNull())
    return sp.summarise_rows(rows, ["symbol", "split"])


@register
def walk_forward(spark, d):
    return sp.summarise_rows(sp.walk_forward(tb.daily_index(spark, d)), ["symbol", "fold", "role"])


@register
def ts_cv_folds(spark, d):
    return sp.summarise_rows(sp.cv_folds(tb.daily_index(spark, d)), ["symbol", "fold", "train_rows", "role"])


def _split_features(spark, d):
    return sp.chronological_split(_feature_rows(spark, d))


@register
def scaler_fit(spark, d):
    stats = sc.fit_scaler(_split_features(spark, d).where("split = 'train'"), FEATURES)
    return rounded(stats, 5, "mean", "scale")


def _scaled(spark, d, fill=None):
    rows = _split_features(spark, d)
    return sc.apply_scaler(rows, sc.fit_scaler(rows.where("split = 'train'"), FEATURES), FEATURES, fill=fill)


@register
def scaled_features(spark, d):
    return _show(_scaled(spark, d, fill=0.0), 5, *FEATURES)


@register
def tabular_split(spark, d):
    rows = _scaled(spark, d).where(F.col("split").isNotNull())
    return rounded(rows.select("symbol", "ts", "split", *FEATURES, "y_reg_h24", "y_clf_h24", "close"), 5, *FEATURES)


def _windows(spark, d):
    rows = materialise(_scaled(spark, d, fill=0.0))
    return sq.sequence_windows(rows, tb.DAILY, FEATURES, ["split", "y_reg_h24", "y_clf_h24"], "y_reg_h24", 168)


def _digest(windows: DataFrame) -> DataFrame:
    """Sums over a whole window, plain and weighted by step and feature, in place of its 168 rows."""
    flat = F.flatten("x")
    add = lambda s, v: s + v
    row = lambda x: F.aggregate(F.transform(x, lambda v, k: v.cast("double") * (k + 1)), F.lit(0.0), add)
    return windows.select(
        "symbol",
        "ts",
        F.size("x").alias("steps"),
        F.round(F.aggregate(flat, F.lit(0.0), lambda s, v: s + v.cast("double")), 3).alias("total"),
        F.round(F.aggregate(F.transform("x", lambda x, i: row(x) * (i + 1)), F.lit(0.0), add), 0).alias("weighted"),
        F.col("x")[0][0].cast("double").alias("oldest"),
        F.element_at(F.element_at("x", -1), -1).cast("double").alias("newest"),
        "split",
        "y_clf_h24",
    )


@register
def sequences(spark, d):
    return rounded(rounded(_digest(_windows(spark, d)).drop("split"), 3, "total", "oldest", "newest"), 0, "weighted")


def _window_sums(meta: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
    """The digest of ``sequences``, from whole windows."""
    wide = x.astype("float64")
    step, column = np.arange(1, x.shape[1] + 1), np.arange(1, x.shape[2] + 1)
    sums = {
        "steps": x.shape[1], "total": wide.sum((1, 2)).round(3), "weighted": np.einsum("nij,i,j->n", wide, step, column).round(0),
        "oldest": wide[:, 0, 0].round(3), "newest": wide[:, -1, -1].round(3),
    }
    return meta[["symbol", "ts"]].assign(**sums, y_clf_h24=meta["y_clf_h24"])


@register
def stored_windows(spark, d):
    """All windows of 168 rows and all features, stored by reference and put together by the reader."""
    rows = materialise(_scaled(spark, d, fill=0.0))
    folder = f"{spark.sparkContext.getCheckpointDir()}/windows-{uuid.uuid4().hex}"
    write_window_store(rows, tb.DAILY, FEATURES, ["split", "y_clf_h24"], "y_reg_h24", folder, 168)
    schema = "symbol string, ts timestamp, steps int, total double, weighted double, oldest double, newest double, y_clf_h24 double"
    out = map_windows(spark, folder, _window_sums, schema)
    return rounded(rounded(out, 3, "total", "oldest", "newest"), 0, "weighted")


@register
def segment_windows(spark, d):
    windows = _windows(spark, d).where(F.col("split").isNotNull())
    return windows.groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_end"), F.max("ts").alias("last_end"), F.min(F.size("x")).alias("steps")
    )


@register
def context_windows(spark, d):
    rows = sq.context_windows(materialise(tb.daily_index(spark, d)), tb.DAILY, 512)
    return rows.select(
        "symbol",
        "ts",
        F.size("context").alias("steps"),
        F.col("context")[0].cast("double").alias("oldest"),
        F.element_at("context", -1).cast("double").alias("newest"),
    )


@register
def train_medians(spark, d):
    return rounded(sc.train_medians(_split_features(spark, d).where("split = 'train'"), FEATURES), 7, "median")


@register
def imputed_features(spark, d):
    rows = _split_features(spark, d)
    return _show(sc.impute(rows, sc.train_medians(rows.where("split = 'train'"), FEATURES), FEATURES), 6, *FEATURES)


@register
def label_recode(spark, d):
    rows = _targets(spark, d).where(F.col("y_clf_h24").isNotNull())
    rows = rows.withColumn("class_index", sc.recode_label("y_clf_h24"))
    return rows.select("symbol", "ts", "class_index", sc.decode_label("class_index").alias("label"))


@register
def downsample(spark, d):
    rows = _complete_index(spark, d)
    return rounded(dg.downsample(rows, 7).select("symbol", "ts", "y_true", "y_pred"), 8, "y_true", "y_pred")


@register
def random_sample(spark, d):
    """200 bars in the order of a seeded hash of their key."""
    bars = tb.daily_bars(spark, d)
    key = F.concat_ws("|", "symbol", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("42"))
    return bars.orderBy(F.md5(key.cast("binary")), "symbol", "ts").limit(200)


# --- baselines --------------------------------------------------------------------------------


@register
def naive_zero(spark, d):
    rows = sp.chronological_split(_targets(spark, d)).where("split IS NOT NULL")
    rows = rows.select("symbol", "ts", "split", F.col("y_reg_h24").alias("y_true"), bl.zero_forecast().alias("y_pred"))
    return rounded(rows, 9, "y_true")


@register
def majority_class(spark, d):
    return bl.majority_class(sp.chronological_split(_targets(spark, d)).where("split = 'train'"), "y_clf_h24")


@register
def majority_pred(spark, d):
    rows = materialise(sp.chronological_split(_targets(spark, d)))
    major = bl.majority_class(rows.where("split = 'train'"), "y_clf_h24")
    out = rows.where("split IS NOT NULL").join(major, "symbol").withColumns(bl.majority_columns())
    return out.select("symbol", "ts", "split", F.col("y_clf_h24").alias("y_true"), "y_pred", "p_neg", "p_neu", "p_pos")


def _ar_rows(spark, d):
    b = Blocked.of(tb.daily_index(spark, d), tb.DAILY, back=7)
    return sp.chronological_split(b.run(bl.lagged_returns(b, max(bl.ORDERS))).home())


@register
def ar_moments(spark, d):
    sums = bl.ar_moments(_ar_rows(spark, d).where("split = 'train'"), ["symbol"])
    return rounded(sums, 5, *[c for c in sums.columns if c.startswith("s_")])


def _fixed_coefs(df: DataFrame) -> DataFrame:
    """The same AR(2) for every series, as a coefficient table."""
    a, b = bl.cumulative_weights([-0.4, 0.2], 0.01, H)
    return df.select("symbol").distinct().select(
        "symbol", F.lit(a).alias("a"), F.array(*[F.lit(float(v)) for v in b]).alias("b")
    )


@register
def ar_forecast(spark, d):
    rows = materialise(sp.chronological_split(tb.daily_index(spark, d)))
    out = bl.attach_forecast(rows, _fixed_coefs(rows), tb.DAILY, H)
    return rounded(out.select("symbol", "ts", "split", "y_pred"), 8, "y_pred")


@register
def ar_labels(spark, d):
    rows = materialise(sp.chronological_split(tb.daily_index(spark, d)))
    out = bl.attach_forecast(rows, _fixed_coefs(rows), tb.DAILY, H)
    return out.select("symbol", "ts", "split", "y_label")


@register
def ar_fit(spark, d):
    """Order, coefficients and forecast map chosen by AIC per series."""
    return bl.fit_ar(bl.ar_moments(_ar_rows(spark, d).where("split = 'train'"), ["symbol"]), ["symbol"], H)


@register
def ar_evaluation(spark, d):
    """Fitted AR forecasts measured on every split."""
    rows = sp.chronological_split(_targets(spark, d))
    rows = materialise(rows.select("symbol", "ts", ROW, ROWS, "close", "y_reg_h24", "split", "split_row"))
    b = Blocked.of(rows, tb.DAILY, back=7)
    train = b.run(bl.lagged_returns(b, max(bl.ORDERS))).home().where("split = 'train'")
    out = bl.attach_forecast(rows, bl.fit_ar(bl.ar_moments(train, ["symbol"]), ["symbol"], H), tb.DAILY, H)
    preds = materialise(out.select("symbol", "ts", "split", F.col("y_reg_h24").alias("y_true"), "y_pred"))
    return split_metrics(preds, "regression")


@register
def ar_fold_fit(spark, d):
    """Order and coefficients by AIC for the train part of every walk-forward fold; returns are read once."""
    b = Blocked.of(sp.foldable(tb.daily_index(spark, d)), tb.DAILY, back=7)
    rows = b.run(bl.lagged_returns(b, max(bl.ORDERS))).home()
    fits = bl.fit_ar(bl.ar_range_moments(rows, tb.DAILY, sp.train_ranges()), ["symbol", "fold"], H)
    phi = {f"phi_{k}": F.get("phi", F.lit(k - 1)) for k in range(1, max(bl.ORDERS) + 1)}
    out = fits.withColumns(phi).select("symbol", "fold", "p", "intercept", *phi, "aic")
    return rounded(rounded(out, 7, "intercept", *phi), 5, "aic")


def _baselines():
    return [
        ZeroForecast(), MajorityClass(), AutoRegression(keys=tb.DAILY.keys),
        AutoRegression(target="y_clf_h24", task="classification", keys=tb.DAILY.keys),
    ]


def _baseline_rows(spark, d):
    rows = sp.chronological_split(_targets(spark, d))
    return materialise(rows.select("symbol", "ts", ROW, ROWS, "close", "y_reg_h24", "y_clf_h24", "split", "split_row"))


@register
def baseline_forecasts(spark, d):
    """Every baseline fitted on train, its forecasts on all splits."""
    rows, out = _baseline_rows(spark, d), None
    for model in _baselines():
        preds, _ = evaluate(model.fit(rows), rows)
        preds = preds.select(F.lit(model.name).alias("model"), F.lit(model.task).alias("task"), "*")
        out = preds if out is None else out.unionByName(preds)
    return rounded(out, 7, "y_true", "y_pred")


@register
def run_ledger(spark, d):
    """What the ledger says of a run of every baseline."""
    rows = _baseline_rows(spark, d)
    ledger = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    for model in _baselines():
        train_and_evaluate(model, rows, ledger)
    return read_runs(spark, ledger).select("model", "task", "target", "n_features", "n_train", "n_val", "n_test")


# --- metrics and diagnostics --------------------------------------------------------------------


def _preds(spark, d):
    return materialise(tb.predictions(spark, d))


def _complete_index(spark, d):
    return index_rows(materialise(mt.complete(tb.predictions(spark, d)).drop(ROW, ROWS)), tb.DAILY)


@register
def regression_metrics(spark, d):
    return rounded(mt.regression_metrics(_preds(spark, d), ["symbol"]), 6, *mt.REGRESSION)


@register
def classification_metrics(spark, d):
    return rounded(mt.classification_metrics(tb.labels(tb.predictions(spark, d)), ["symbol"]), 9, *mt.CLASSIFICATION)


@register
def confusion(spark, d):
    return rounded(mt.confusion(tb.labels(tb.predictions(spark, d)), ["symbol"]), 6, "neg_pct", "neu_pct", "pos_pct")


@register
def class_report(spark, d):
    return rounded(mt.class_report(tb.labels(tb.predictions(spark, d)), ["symbol"]), 9, "precision", "recall", "f1")


@register
def roc_auc(spark, d):
    return rounded(mt.roc_auc(tb.labels(tb.predictions(spark, d)), ["symbol"]), 9, "auc")


@register
def roc_curve(spark, d):
    return rounded(mt.roc_points(tb.labels(tb.predictions(spark, d)), ["symbol"]), 9, "fpr", "tpr")


@register
def pr_ap(spark, d):
    return rounded(mt.average_precision(tb.labels(tb.predictions(spark, d)), ["symbol"]), 9, "average_precision", "prevalence")


@register
def monthly_dir_acc(spark, d):
    return rounded(dg.monthly_accuracy(tb.predictions(spark, d), ["symbol"]), 9, "dir_acc")


@register
def residual_hist(spark, d):
    out = dg.residual_histogram(_preds(spark, d), ["symbol"])
    return rounded(out, 7, "left_edge", "density", "mu", "sigma")


@register
def residual_trend(spark, d):
    return rounded(dg.residual_trend(_complete_index(spark, d), tb.DAILY, 2), 7, "residual", "trend")


@register
def pred_actual_grid(spark, d):
    return dg.density_grid(_preds(spark, d), ["symbol"])


@register
def sign_quadrants(spark, d):
    return rounded(dg.sign_quadrants(tb.predictions(spark, d), ["symbol"]), 9, "dir_acc")


@register
def prob_boxes(spark, d):
    out = dg.probability_boxes(tb.labels(_preds(spark, d)).dropna(subset=["p_neg"]), ["symbol"])
    return rounded(out, 6, "q1", "median", "q3")


@register
def model_compare(spark, d):
    preds = _preds(spark, d)
    chained = sp.chronological_split(preds)
    rows = chained.where(F.col("split").isNotNull())
    naive = split_metrics(rows.withColumn("y_pred", bl.zero_forecast()), "regression")
    lean = split_metrics(rows, "regression")
    ledger = naive.select(F.lit("naive_zero").alias("model"), "*").unionByName(lean.select(F.lit("reversal").alias("model"), "*"))
    return rounded(dg.model_comparison(ledger.withColumn("task", F.lit("regression")), "rmse"), 8, "train", "val", "test")


@register
def leakage_audit_full(spark, d):
    """Bank recomputed on truncated series; zero mismatches is the pass."""

    def build(bars, spec):
        b = Blocked.of(index_rows(bars, spec), spec, back=ta.BANK_REACH + 1)
        rows = materialise(b.run(ta.technical_stages(b, 1)).home())
        return ta.smoothed_columns(rows, spec)

    bars = tb.stored_daily(spark, d).drop("n_ticks")
    return leakage_audit(bars, build, ta.TECHNICAL, tb.DAILY)


@register
def perturbation_audit_full(spark, d):
    """Every feature of all families at every row left of a changed future; zero mismatches is the pass."""
    bars = materialise(tb.daily_bars(spark, d).drop("n_ticks"))
    aligned = aligned_bars(bars, tb.external(spark, d), tb.SOURCES, tb.DAILY)
    return perturbation_audit(aligned, feature_matrix, AUDITED, tb.DAILY)


@register
def perturbation_audit_leaky(spark, d):
    """The same audit on features that do look ahead, which it has to find."""

    def build(bars, spec):
        b = Blocked.of(index_rows(bars, spec), spec, back=1, ahead=3)
        rows = b.run([{"peek_3": b.lead("close", 3), "no_lag": F.col("close"), "lagged": b.lag("close", 1)}]).home()
        means = bars.groupBy(*spec.keys).agg(F.avg("close").alias("_mean"))
        return rows.join(means, list(spec.keys)).withColumn("whole_mean", F.col("close") / F.col("_mean"))

    bars = tb.stored_daily(spark, d).drop("n_ticks")
    return perturbation_audit(bars, build, ["peek_3", "no_lag", "lagged", "whole_mean"], tb.DAILY)


@register
def target_spot_check(spark, d):
    return target_audit(materialise(_targets(spark, d)), tb.DAILY, "y_reg_h24", H)


# --- tree models ---------------------------------------------------------------------------------


def _model_rows(spark, d):
    return materialise(_split_features(spark, d))


def _forest(task="regression", **params):
    target = "y_reg_h24" if task == "regression" else "y_clf_h24"
    return RandomForest(FEATURES, target, task, params={"numTrees": 12, "maxDepth": 5, **params})


def _boosted(task="regression", **params):
    target = "y_reg_h24" if task == "regression" else "y_clf_h24"
    return BoostedTrees(FEATURES, target, task, params={"maxIter": 8, "maxDepth": 3, **params})


@register
def rf_regression(spark, d):
    return train_and_evaluate(_forest(), _model_rows(spark, d))


@register
def rf_classification(spark, d):
    return train_and_evaluate(_forest("classification"), _model_rows(spark, d))


@register
def gbt_regression(spark, d):
    return train_and_evaluate(_boosted(), _model_rows(spark, d))


@register
def gbt_classification(spark, d):
    return train_and_evaluate(_boosted("classification", maxIter=4), _model_rows(spark, d))


@register
def feature_importance(spark, d):
    return dg.top_importances(_forest().fit(_model_rows(spark, d)).importances())


@register
def hyperparameter_search(spark, d):
    space = {"maxDepth": ("int", 2, 6, 1), "minInstancesPerNode": ("int", 1, 10, 1)}
    _, trials = tune(lambda p: _forest(**{"numTrees": 6, **p}), space, _model_rows(spark, d), trials=2)
    return trials.select("trial", "loss")


@register
def train_evaluate(spark, d):
    """Forest predictions on every split, as the ledger stores them."""
    rows = _model_rows(spark, d)
    preds, _ = evaluate(_forest().fit(rows), rows)
    return preds


@register
def learning_curve_table(spark, d):
    rows = _feature_rows(spark, d)
    return learning_curve(lambda: _forest(numTrees=4, maxDepth=3), rows, splits=2, shares=(0.5, 1.0))
