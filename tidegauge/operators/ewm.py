"""Exponentially weighted means as an affine scan over blocks.

With ``d = 1 - alpha`` and ``g`` rows since the last observation, an observation ``x``
moves the mean ``e`` to ``(d**g * e + alpha * x) / (d**g + alpha)`` and a missing value
leaves it alone. Each step is an affine map, so a block is summed up by one map:

1. inside a block, running sums give every row as ``scale * seed + local``, where ``seed``
   is the mean at the first observation of the block;
2. one row per block carries the map of the block; those rows are folded in groups of
   bounded size, then the groups are folded per series;
3. the folded carry is joined back on (series, block), the partitioning the rows have.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.blocks import BLOCK, ROW, SeriesSpec
from tidegauge.session import materialise

FOLD_WIDTH = 256
_MAX_EXPONENT = 600.0


@dataclass(frozen=True)
class Ewm:
    """Mean of ``column`` with weight ``alpha``; NULL before ``min_periods`` observations."""

    column: str
    alpha: float
    min_periods: int = 1

    @classmethod
    def of_span(cls, column: str, span: float, min_periods: int = 1) -> Ewm:
        return cls(column, 2.0 / (span + 1.0), min_periods)


def ewm_means(df: DataFrame, spec: SeriesSpec, wanted: dict[str, Ewm]) -> DataFrame:
    """Add one column per entry of ``wanted`` to indexed rows (``rn`` present, no copies).

    ``df`` is read twice: hand in a stored table or a materialised frame. Means so short that
    their weights would underflow within a block are scanned in shorter blocks of their own.
    """
    by_size: dict[int, dict[str, Ewm]] = {}
    for name, ewm in wanted.items():
        if not 0.0 < ewm.alpha <= 1.0:
            raise ValueError(f"{name}: alpha must lie in (0, 1]")
        # at alpha 1 the mean is the last observation; any smaller block size serves it
        longest = _MAX_EXPONENT / -math.log1p(-ewm.alpha) if ewm.alpha < 1.0 else 16.0
        by_size.setdefault(min(spec.block_rows, max(2, int(longest))), {})[name] = ewm
    out = df
    for size in sorted(by_size):
        out = _scanned(out if out is df else materialise(out), replace(spec, block_rows=size), by_size[size])
    if by_size and max(by_size) != spec.block_rows:
        out = out.withColumn(BLOCK, F.expr(f"{ROW} DIV {spec.block_rows}"))
    return out


def _scanned(df: DataFrame, spec: SeriesSpec, wanted: dict[str, Ewm]) -> DataFrame:
    """``ewm_means`` for means that ``spec.block_rows`` is short enough for."""
    size, keys = spec.block_rows, ", ".join(f"`{k}`" for k in spec.block_keys)
    upto = f"OVER (PARTITION BY {keys} ORDER BY {ROW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    prior = f"OVER (PARTITION BY {keys} ORDER BY {ROW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    means = [_Tagged(f"_e{i}", name, ewm) for i, (name, ewm) in enumerate(wanted.items())]

    rows = df.withColumn(BLOCK, F.expr(f"{ROW} DIV {size}"))
    rows = _stage(
        rows,
        means,
        prev=lambda m: f"last(if({m.x} IS NULL, NULL, {ROW}), true) {prior}",
        seen=lambda m: f"count({m.x}) {upto}",
    )
    # the step from the previous observation of the block; 0 elsewhere
    rows = _stage(rows, means, fade=lambda m: f"if({m.x} IS NULL, NULL, pow({m.keep!r}D, {ROW} - {m.t}_prev))")
    rows = _stage(
        rows,
        means,
        b=lambda m: f"coalesce({m.alpha!r}D * {m.x} / ({m.t}_fade + {m.alpha!r}D), 0D)",
        ls=lambda m: f"sum(coalesce(ln({m.t}_fade / ({m.t}_fade + {m.alpha!r}D)), 0D)) {upto}",
    )
    rows = _stage(rows, means, loc=lambda m: f"exp({m.t}_ls) * sum({m.t}_b * exp(-{m.t}_ls)) {upto}")

    joined = rows.join(_block_carries(rows, spec, means), spec.block_keys, "left")
    out: dict[str, Column] = {}
    for i, m in enumerate(means):
        value = f"if({m.t}_seen = 0, if(_count[{i}] > 0, _carry[{i}], NULL), exp({m.t}_ls) * _seed[{i}] + {m.t}_loc)"
        out[m.name] = F.expr(f"if(_count[{i}] + {m.t}_seen >= {max(m.ewm.min_periods, 1)}, {value}, NULL)")
    helpers = [f"{m.t}_{part}" for m in means for part in ("prev", "seen", "fade", "b", "ls", "loc")]
    return joined.withColumns(out).drop(*helpers, "_carry", "_seed", "_count")


@dataclass(frozen=True)
class _Tagged:
    """A wanted mean with the prefix ``t`` of its helper columns."""

    t: str
    name: str
    ewm: Ewm

    @property
    def x(self) -> str:
        return f"`{self.ewm.column}`"

    @property
    def alpha(self) -> float:
        return min(self.ewm.alpha, 1.0 - 1e-15)

    @property
    def keep(self) -> float:
        return 1.0 - self.alpha


def _stage(df: DataFrame, means: list[_Tagged], **parts: Callable[[_Tagged], str]) -> DataFrame:
    """One pass that adds ``<t>_<part>`` for every mean."""
    return df.withColumns({f"{m.t}_{part}": F.expr(sql(m)) for m in means for part, sql in parts.items()})


def _block_carries(rows: DataFrame, spec: SeriesSpec, means: list[_Tagged]) -> DataFrame:
    """Per (series, block): mean carried in, mean at the first observation, count before."""
    keys = ", ".join(f"`{k}`" for k in spec.keys)
    aggs = [
        F.expr(sql)
        for m in means
        for sql in (
            f"count({m.x}) AS {m.t}_n",
            f"min(if({m.x} IS NULL, NULL, {ROW})) AS {m.t}_first",
            f"max(if({m.x} IS NULL, NULL, {ROW})) AS {m.t}_last",
            f"min_by({m.x}, if({m.x} IS NULL, NULL, {ROW})) AS {m.t}_x",
            f"max_by(exp({m.t}_ls), {ROW}) AS {m.t}_scale",
            f"max_by({m.t}_loc, {ROW}) AS {m.t}_local",
        )
    ]
    blocks = rows.groupBy(*spec.block_keys).agg(*aggs)
    before = f"OVER (PARTITION BY {keys} ORDER BY {BLOCK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = _stage(
        blocks,
        means,
        lastb=lambda m: f"max({m.t}_last) {before}",
        nb=lambda m: f"coalesce(sum({m.t}_n) {before}, 0)",
    )
    # the map of the first observation, (0, x) when nothing came before it
    blocks = _stage(blocks, means, f1=lambda m: f"pow({m.keep!r}D, {m.t}_first - {m.t}_lastb)")
    blocks = _stage(
        blocks,
        means,
        a1=lambda m: f"if({m.t}_n = 0, 1D, coalesce({m.t}_f1 / ({m.t}_f1 + {m.alpha!r}D), 0D))",
        b1=lambda m: f"if({m.t}_n = 0, 0D, coalesce({m.alpha!r}D * {m.t}_x / ({m.t}_f1 + {m.alpha!r}D), {m.t}_x))",
    )
    blocks = _stage(
        blocks,
        means,
        a=lambda m: f"if({m.t}_n = 0, 1D, {m.t}_scale * {m.t}_a1)",
        b=lambda m: f"if({m.t}_n = 0, 0D, {m.t}_scale * {m.t}_b1 + {m.t}_local)",
    )

    def gather(part: str, name: str) -> str:
        return f"array({', '.join(f'{m.t}_{part}' for m in means)}) AS {name}"

    # one short row per block, stored: the fold reads it twice
    maps = materialise(
        blocks.selectExpr(
            *(f"`{k}`" for k in spec.block_keys),
            gather("a", "a"),
            gather("b", "b"),
            f"struct({gather('a1', 'a1')}, {gather('b1', 'b1')}, {gather('nb', 'n')}) AS rest",
        )
    )
    carried = affine_carries(maps, list(spec.keys), BLOCK, len(means))
    return carried.selectExpr(
        *(f"`{k}`" for k in spec.block_keys),
        "_carry",
        f"{_apply('rest.a1', '_carry', 'rest.b1')} AS _seed",
        "rest.n AS _count",
    )


def _apply(a: str, x: str, b: str) -> str:
    """``a * x + b``, element by element."""
    return f"zip_with(zip_with({a}, {x}, (p, q) -> p * q), {b}, (p, q) -> p + q)"


def _fold(steps: str, width: int, rest: str) -> str:
    """Fold sorted affine maps; ``out`` holds the map of everything before each step."""
    vector = "array<double>"
    start = (
        f"named_struct('a', array_repeat(1D, {width}), 'b', array_repeat(0D, {width}), "
        f"'out', cast(array() AS array<struct<i:bigint,a:{vector},b:{vector},rest:{rest}>>))"
    )
    merged = (
        "named_struct('a', zip_with(t.a, s.a, (p, q) -> p * q), "
        f"'b', {_apply('t.a', 's.b', 't.b')}, "
        "'out', concat(s.out, array(named_struct('i', t.i, 'a', s.a, 'b', s.b, 'rest', t.rest))))"
    )
    return f"aggregate({steps}, {start}, (s, t) -> {merged})"


def affine_carries(maps: DataFrame, keys: list[str], index: str, width: int) -> DataFrame:
    """Add ``_carry``: the value reached before each map when the series starts at zero.

    ``maps`` holds ``(keys, index, a, b, rest)``. Two levels keep every array short: groups
    of ``FOLD_WIDTH`` maps, then the groups of a series.
    """
    names = [f"`{k}`" for k in keys]
    rest = maps.schema["rest"].dataType.simpleString()
    groups = (
        maps.selectExpr(*names, f"`{index}` DIV {FOLD_WIDTH} AS _g", f"struct(`{index}` AS i, a, b, rest) AS s")
        .groupBy(*keys, "_g")
        .agg(F.expr("array_sort(collect_list(s), (l, r) -> int(sign(l.i - r.i))) AS s"))
        .selectExpr(*names, "_g", f"{_fold('s', width, rest)} AS f")
    )
    tops = (
        groups.selectExpr(*names, "struct(_g AS i, f.a AS a, f.b AS b, 0 AS rest) AS s")
        .groupBy(*keys)
        .agg(F.expr("array_sort(collect_list(s), (l, r) -> int(sign(l.i - r.i))) AS s"))
        .selectExpr(*names, f"explode({_fold('s', width, 'int')}.out) AS o")
        .selectExpr(*names, "o.i AS _g", "o.b AS _top")
    )
    return (
        groups.selectExpr(*names, "_g", "explode(f.out) AS o")
        .join(tops, [*keys, "_g"])
        .selectExpr(*names, f"o.i AS `{index}`", f"{_apply('o.a', '_top', 'o.b')} AS _carry", "o.rest AS rest")
    )
