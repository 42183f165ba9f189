"""Bars and externals to the feature and target table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.calendar import CALENDAR, calendar_columns
from tidegauge.functions.external import (
    BAR_COLUMNS,
    EXTERNAL_REACH,
    RECIPES,
    macro_names,
    macro_stages,
    route,
    sentiment_names,
    sentiment_stages,
)
from tidegauge.functions.target import target_stages
from tidegauge.functions.technical import (
    BANK_REACH,
    SMOOTHING_INPUTS,
    TECHNICAL,
    smoothed_columns,
    technical_stages,
)
from tidegauge.operators.asof import align_sources
from tidegauge.operators.blocks import ROW, ROWS, Blocked, SeriesSpec, index_rows
from tidegauge.session import materialise

#: rows always cut from the start of a series
MIN_WARMUP = 200


@dataclass(frozen=True)
class FeatureConfig:
    horizon: int = 24
    lookback: int = 168
    lag: int = 1
    factor: float = 0.5
    vol_window: int = 24
    recipes: Mapping[str, str] = field(default_factory=lambda: dict(RECIPES))

    @property
    def targets(self) -> list[str]:
        return [f"y_reg_h{self.horizon}", f"y_clf_h{self.horizon}", "y_clf_threshold"]

    @property
    def warmup(self) -> int:
        return max(self.lookback, MIN_WARMUP)


def feature_names(columns: Sequence[str], spec: SeriesSpec, config: FeatureConfig) -> list[str]:
    """Everything but keys, time, row numbers, bar columns and targets."""
    other = {*spec.keys, spec.ts, ROW, ROWS, *BAR_COLUMNS, "n_ticks", *config.targets}
    return [c for c in columns if c not in other]


def aligned_bars(bars: DataFrame, external: DataFrame, sources: Sequence[str], spec: SeriesSpec) -> DataFrame:
    """Bars with one column per source, stored once for the passes that follow."""
    return materialise(align_sources(bars, external, sources, spec))


def feature_matrix(aligned: DataFrame, spec: SeriesSpec, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Bar columns, technical, macro, sentiment and calendar features and targets.

    ``aligned`` must be stored or materialised. The warm-up rows are gone, and ``rn`` and
    ``n_rows`` count the rows that are left.
    """
    ignore = (*spec.keys, spec.ts, "n_ticks")
    macro, sentiment = route(aligned.columns, ignore)
    reach = config.lag + max(BANK_REACH, EXTERNAL_REACH, config.vol_window + 1)
    b = Blocked.of(index_rows(aligned, spec), spec, back=reach, ahead=config.horizon)
    b = b.run(
        technical_stages(b, config.lag),
        macro_stages(b, macro, config.lag, config.recipes),
        sentiment_stages(b, sentiment, config.lag),
        target_stages(b, config.horizon, config.vol_window, config.factor),
    )
    external = macro_names(macro, config.recipes) + sentiment_names(sentiment)
    finite = [c for c in TECHNICAL if c in b.df.columns]
    # stored for the two passes of the exponential means
    rows = materialise(
        b.home().select(
            *spec.keys, spec.ts, ROW, ROWS, *BAR_COLUMNS, *finite, *SMOOTHING_INPUTS, *external, *config.targets
        )
    )
    rows = smoothed_columns(rows, spec).withColumns(calendar_columns(spec.ts))
    kept = rows.where(F.col(ROW) >= config.warmup).withColumns(
        {ROW: F.col(ROW) - config.warmup, ROWS: F.col(ROWS) - config.warmup}
    )
    return kept.select(
        *spec.keys, spec.ts, ROW, ROWS, *BAR_COLUMNS, *TECHNICAL, *external, *CALENDAR, *config.targets
    )
