"""Features of aligned macro and sentiment columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F

from tidegauge.functions.technical import side_by_side
from tidegauge.operators.blocks import Blocked, Stages

#: rows the blocks need for these features, besides the lag
EXTERNAL_REACH = 168

# fixed values: how each known source is transformed; others keep their level
RECIPES: dict[str, str] = {
    "dxy": "logret",
    "vix": "logret",
    "spx500": "logret",
    "brent_oil": "logret",
    "us10y_yield": "delta",
    "fed_funds": "delta",
    "real_rate_10y": "delta",
    "cpi_yoy": "delta",
}

# fixed values: name prefixes of sentiment columns
SENTIMENT_PREFIXES = ("fear_greed", "google_trends")

#: columns that are never external
BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def route(columns: Sequence[str], ignore: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Split column names into (macro, sentiment)."""
    candidates = [c for c in columns if c not in BAR_COLUMNS and c not in ignore]
    sentiment = [c for c in candidates if c.startswith(SENTIMENT_PREFIXES)]
    return [c for c in candidates if c not in sentiment], sentiment


def macro_names(columns: Sequence[str], recipes: Mapping[str, str] = RECIPES) -> list[str]:
    """Feature names of :func:`macro_stages`, in order."""
    suffixes = {"logret": ("logret_1", "logret_24", "z168"), "delta": ("d1", "d24", "z168")}
    return [f"{c}_{s}" for c in columns for s in suffixes.get(recipes.get(c, "level"), ("level", "z168"))]


def macro_stages(b: Blocked, columns: Sequence[str], lag: int = 1, recipes: Mapping[str, str] = RECIPES) -> Stages:
    """Changes over 1 and 24 bars (of the log or the level) or the level, each with a z-score."""
    plans: list[Stages] = []
    for i, column in enumerate(columns):
        raw, base = f"_m{i}", f"_mb{i}"
        kind = recipes.get(column, "level")
        scored = {f"{column}_z168": b.zscore(raw, 168)}
        if kind == "level":
            plans.append([{raw: b.lag(column, lag)}, {f"{column}_level": F.col(raw), **scored}])
            continue
        log = kind == "logret"
        level = F.ln(F.nullif(F.col(raw), F.lit(0.0))) if log else F.col(raw)
        one, day = (f"{column}_logret_1", f"{column}_logret_24") if log else (f"{column}_d1", f"{column}_d24")
        plans.append(
            [
                {raw: b.lag(column, lag)},
                {base: level, **scored},
                {one: b.diff(base, 1), day: b.diff(base, 24)},
            ]
        )
    return side_by_side(*plans)


def sentiment_names(columns: Sequence[str]) -> list[str]:
    return [f"{c}_{s}" for c in columns for s in ("level", "ma24", "z168")]


def sentiment_stages(b: Blocked, columns: Sequence[str], lag: int = 1) -> Stages:
    """Level, 24-bar mean and 168-bar z-score."""
    plans: list[Stages] = []
    for i, column in enumerate(columns):
        raw = f"_s{i}"
        plans.append(
            [
                {raw: b.lag(column, lag)},
                {
                    f"{column}_level": F.col(raw),
                    f"{column}_ma24": b.mean(raw, 24),
                    f"{column}_z168": b.zscore(raw, 168),
                },
            ]
        )
    return side_by_side(*plans)
