"""Price indicators over blocked series.

Every indicator is a list of column stages for :meth:`Blocked.run`; the plans of several
indicators run side by side. Columns are in natural timing: row ``t`` describes bars up to
``t``. The full bank shifts its *inputs* by ``lag`` bars instead of its results: all
indicators are causal, so both are the same, and the shift costs no pass of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.blocks import ROW, Blocked, SeriesSpec, Stages
from tidegauge.operators.ewm import Ewm, ewm_means

#: columns of the full bank, in order
TECHNICAL = (
    "logret_1", "logret_4", "logret_24", "logret_168",
    "rv_24", "rv_168", "zscore_24", "zscore_168",
    "rsi_14", "macd_line", "macd_signal", "macd_hist",
    "roc_10", "willr_14", "stoch_k", "stoch_d", "cci_20",
    "bb_upper", "bb_lower", "bb_pctb", "bb_bw", "atr_14", "adx_14",
)

#: bars a full bank looks back, besides the unbounded exponential means
BANK_REACH = 170

#: columns the exponential means of the bank start from
SMOOTHING_INPUTS = ("_c", "_gain", "_loss", "_tr", "_pdm", "_mdm")


def log_returns(b: Blocked, lags=(1,), close: str = "close") -> Stages:
    return [{"_lc": F.ln(close)}, {f"logret_{k}": b.diff("_lc", k) for k in lags}]


def realized_volatility(b: Blocked, windows=(24,), close: str = "close") -> Stages:
    return [*log_returns(b, (1,), close), {f"rv_{n}": b.std("logret_1", n) for n in windows}]


def close_zscore(b: Blocked, windows=(24,), close: str = "close") -> Stages:
    return [{f"zscore_{n}": b.zscore(close, n) for n in windows}]


def rate_of_change(b: Blocked, period: int = 10, close: str = "close") -> Stages:
    return [{f"roc_{period}": b.pct_change(close, period) * 100.0}]


def channel(b: Blocked, period: int = 14, high: str = "high", low: str = "low") -> Stages:
    """Highest high and lowest low, shared by Williams %R and the stochastic."""
    return [{f"_hh{period}": b.max(high, period), f"_ll{period}": b.min(low, period)}]


def williams_r(b: Blocked, period: int = 14, high="high", low="low", close="close") -> Stages:
    top, bottom = F.col(f"_hh{period}"), F.col(f"_ll{period}")
    return [
        *channel(b, period, high, low),
        {f"willr_{period}": F.try_divide(-100.0 * (top - F.col(close)), top - bottom)},
    ]


def stochastic(b: Blocked, k: int = 14, d: int = 3, high="high", low="low", close="close") -> Stages:
    top, bottom = F.col(f"_hh{k}"), F.col(f"_ll{k}")
    return [
        *channel(b, k, high, low),
        {"stoch_k": F.try_divide(100.0 * (F.col(close) - bottom), top - bottom)},
        {"stoch_d": b.mean("stoch_k", d)},
    ]


def cci(b: Blocked, period: int = 20, high="high", low="low", close="close") -> Stages:
    """Deviation of each bar from its *own* mean, averaged: valid from row ``2 * period - 2``."""
    return [
        {"_tp": (F.col(high) + F.col(low) + F.col(close)) / 3.0},
        {"_tpd": F.col("_tp") - b.mean("_tp", period)},
        {f"cci_{period}": F.try_divide(F.col("_tpd"), 0.015 * b.mean("abs(_tpd)", period))},
    ]


def bollinger(b: Blocked, period: int = 20, width: float = 2.0, close: str = "close") -> Stages:
    upper, lower = F.col("_bm") + width * F.col("_bs"), F.col("_bm") - width * F.col("_bs")
    return [
        {"_bm": b.mean(close, period), "_bs": b.std(close, period)},
        {
            "bb_upper": upper,
            "bb_lower": lower,
            "bb_pctb": F.try_divide(F.col(close) - lower, upper - lower),
            "bb_bw": F.try_divide(upper - lower, F.col("_bm")),
        },
    ]


def momentum_inputs(b: Blocked, close: str = "close") -> Stages:
    """Gains and losses for the RSI."""
    move = F.col("_dc")
    return [
        {"_dc": b.diff(close, 1)},
        {
            "_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))),
            "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))),
        },
    ]


def range_inputs(b: Blocked, high="high", low="low", close="close", first_row: int = 0) -> Stages:
    """True range and directional moves; the first bar has its range and zero moves."""
    h, lo, pc, up, dn = F.col(high), F.col(low), F.col("_pc"), F.col("_up"), F.col("_dn")
    started = F.col(ROW) >= first_row
    return [
        {"_pc": b.lag(close, 1), "_up": b.diff(high, 1), "_dn": b.lag(low, 1) - F.col(low)},
        {
            "_tr": F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)),
            "_pdm": F.when(started, F.when((up > dn) & (up > 0), up).otherwise(0.0)),
            "_mdm": F.when(started, F.when((dn > up) & (dn > 0), dn).otherwise(0.0)),
        },
    ]


def technical_stages(b: Blocked, lag: int = 1) -> Stages:
    """Finite-frame indicators and the smoothing inputs, ``lag`` bars late."""
    hlc = {"high": "_h", "low": "_l", "close": "_c"}
    shifted = [{"_h": b.lag("high", lag), "_l": b.lag("low", lag), "_c": b.lag("close", lag)}]
    plans = [
        [*log_returns(b, (1, 4, 24, 168), "_c"), {f"rv_{n}": b.std("logret_1", n) for n in (24, 168)}],
        close_zscore(b, (24, 168), "_c"),
        rate_of_change(b, 10, "_c"),
        williams_r(b, 14, **hlc),
        stochastic(b, **hlc),
        cci(b, 20, **hlc),
        bollinger(b, 20, 2.0, "_c"),
        momentum_inputs(b, "_c"),
        range_inputs(b, **hlc, first_row=lag),
    ]
    return shifted + side_by_side(*plans)


def side_by_side(*plans: Stages) -> Stages:
    merged: Stages = []
    for plan in plans:
        for i, stage in enumerate(plan):
            if i == len(merged):
                merged.append({})
            merged[i].update(stage)
    return merged


def rsi_means(period: int = 14) -> dict[str, Ewm]:
    return {"_ag": Ewm("_gain", 1.0 / period, period), "_al": Ewm("_loss", 1.0 / period, period)}


def macd_means(fast: int = 12, slow: int = 26, close: str = "close") -> dict[str, Ewm]:
    return {"_ef": Ewm.of_span(close, fast), "_es": Ewm.of_span(close, slow)}


def range_means(period: int = 14) -> dict[str, Ewm]:
    a = 1.0 / period
    return {f"atr_{period}": Ewm("_tr", a, period), "_ep": Ewm("_pdm", a), "_em": Ewm("_mdm", a)}


def finish_rsi(df: DataFrame, period: int = 14) -> DataFrame:
    """100 - 100/(1 + gain/loss); no loss at all gives NULL."""
    rs = F.try_divide(F.col("_ag"), F.col("_al"))
    return df.withColumn(f"rsi_{period}", 100.0 - 100.0 / (1.0 + rs))


def directional_index(df: DataFrame, period: int = 14) -> DataFrame:
    """``_dx`` from the smoothed moves, the input of the ADX mean."""
    atr = F.col(f"atr_{period}")
    plus, minus = F.try_divide(100.0 * F.col("_ep"), atr), F.try_divide(100.0 * F.col("_em"), atr)
    return df.withColumn("_dx", F.try_divide(100.0 * F.abs(plus - minus), plus + minus))


def smoothed_columns(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """RSI, MACD, ATR and ADX from the smoothing inputs."""
    rows = ewm_means(rows, spec, {**rsi_means(), **macd_means(close="_c"), **range_means()})
    rows = directional_index(finish_rsi(rows)).withColumn("macd_line", F.col("_ef") - F.col("_es"))
    rows = ewm_means(
        rows,
        spec,
        {"macd_signal": Ewm.of_span("macd_line", 9), "adx_14": Ewm("_dx", 1.0 / 14, 14)},
    )
    return rows.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))
