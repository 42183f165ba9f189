"""Series laid out in bounded blocks.

A window partitioned by series alone puts a whole series into one task. Here each series
is numbered with a two-step count (per time bucket, then over buckets) and cut into blocks
of ``block_rows`` consecutive rows. A block also receives copies of the last ``back`` rows
before it and the first ``ahead`` rows after it, so every finite frame is exact inside the
block and one long series spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROW = "rn"
ROWS = "n_rows"
BLOCK = "_blk"
HOME = "_home"
_BUCKET = "_tb"


@dataclass(frozen=True)
class SeriesSpec:
    """Names and block sizes of a set of series with one row per bar."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    bar_seconds: int = 3600
    block_rows: int = 2048

    def with_keys(self, *keys: str) -> SeriesSpec:
        return replace(self, keys=keys)

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, BLOCK]


def time_bucket(ts: str, bar_seconds: int, block_rows: int) -> Column:
    """Number of the time span that holds at most ``block_rows`` regular bars."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(bar_seconds * block_rows))


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def index_rows(df: DataFrame, spec: SeriesSpec, tie_break: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based row number ``rn`` and the row count ``n_rows`` of every series.

    ``df`` is read twice, so hand in a stored table or a materialised frame.
    """
    keys = list(spec.keys)
    tagged = df.withColumn(_BUCKET, time_bucket(spec.ts, spec.bar_seconds, spec.block_rows))
    counts = tagged.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_c"))
    series = Window.partitionBy(*keys)
    starts = counts.select(
        *keys,
        _BUCKET,
        F.coalesce(
            F.sum("_c").over(series.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
        F.sum("_c").over(series).alias(ROWS),
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(spec.ts, *tie_break)
    return (
        tagged.withColumn("_r", F.row_number().over(inside))
        .join(starts, [*keys, _BUCKET])
        .withColumn(ROW, F.col("_start") + F.col("_r") - 1)
        .drop("_r", "_start", _BUCKET)
    )


#: columns to add one stage after another; a stage may use the columns of earlier stages
Stages = list[dict[str, Column]]


class Blocked:
    """Indexed rows copied into blocks, with the rolling operators of the engine.

    ``back`` and ``ahead`` bound how far a home row may look. Reaches of chained columns
    add up: a 20-row mean over a column that itself looks 20 rows back needs ``back >= 38``.
    """

    def __init__(self, df: DataFrame, spec: SeriesSpec, back: int, ahead: int = 0) -> None:
        self.df, self.spec, self.back, self.ahead = df, spec, back, ahead

    @classmethod
    def of(cls, indexed: DataFrame, spec: SeriesSpec, back: int, ahead: int = 0) -> Blocked:
        size = F.lit(spec.block_rows)
        first = F.greatest(F.floor((F.col(ROW) - ahead) / size), F.lit(0))
        last = F.least(F.floor((F.col(ROW) + back) / size), F.floor((F.col(ROWS) - 1) / size))
        spread = indexed.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(
            HOME, F.floor(F.col(ROW) / size) == F.col(BLOCK)
        )
        # a wide frame costs far more than its bytes suggest, so the partition count is given
        # and not left to the size-based merging of small partitions
        return cls(spread.repartition(shuffle_width(indexed), *spec.block_keys), spec, back, ahead)

    def run(self, *plans: Stages) -> Blocked:
        """Add the columns of several plans, stage by stage side by side.

        All windows share one partitioning and order, so a stage is one window pass
        however many plans take part, and no stage shuffles or sorts again.
        """
        df = self.df
        for stage in range(max(map(len, plans), default=0)):
            columns: dict[str, Column] = {}
            for plan in plans:
                if stage < len(plan):
                    columns.update(plan[stage])
            df = df.withColumns(columns)
        return Blocked(df, self.spec, self.back, self.ahead)

    def home(self) -> DataFrame:
        """The rows themselves, without the copies."""
        return self.df.where(HOME).drop(HOME, BLOCK)

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.spec.block_keys).orderBy(ROW)

    def frame(self, n: int) -> WindowSpec:
        """The current row and the ``n - 1`` rows before it."""
        self._reaches(n - 1)
        return self.order.rowsBetween(-(n - 1), 0)

    # The operators below take a column name or an SQL call and build one SQL text each:
    # a bank has hundreds of window calls, and a text crosses to the JVM in one piece.

    def lag(self, x: str, k: int = 1) -> Column:
        return F.expr(self._lag(x, k))

    def lead(self, x: str, k: int = 1) -> Column:
        if k > self.ahead:
            raise ValueError(f"a lead of {k} rows needs ahead >= {k}, got {self.ahead}")
        return F.expr(f"lead({_sql(x)}, {k}) {self._over()}" if k else _sql(x))

    def diff(self, x: str, k: int = 1) -> Column:
        return F.expr(f"{_sql(x)} - {self._lag(x, k)}")

    def pct_change(self, x: str, k: int) -> Column:
        return F.expr(f"try_divide({_sql(x)}, {self._lag(x, k)}) - 1")

    def mean(self, x: str, n: int) -> Column:
        return self._full(x, n, self._rolling("avg", x, n))

    def std(self, x: str, n: int) -> Column:
        return self._full(x, n, self._rolling("stddev_samp", x, n))

    def min(self, x: str, n: int) -> Column:
        return self._full(x, n, self._rolling("min", x, n))

    def max(self, x: str, n: int) -> Column:
        return self._full(x, n, self._rolling("max", x, n))

    def mean_available(self, x: str, n: int) -> Column:
        """Rolling mean over whatever part of the frame exists."""
        return F.expr(self._rolling("avg", x, n))

    def zscore(self, x: str, n: int) -> Column:
        centred = f"{_sql(x)} - {self._rolling('avg', x, n)}"
        return self._full(x, n, f"try_divide({centred}, {self._rolling('stddev_samp', x, n)})")

    def _full(self, x: str, n: int, value: str) -> Column:
        """``value`` where the frame of ``n`` rows holds no missing ``x``, else NULL."""
        return F.expr(f"CASE WHEN {self._rolling('count', x, n)} = {n} THEN {value} END")

    def _reaches(self, k: int) -> None:
        if k > self.back:
            raise ValueError(f"looking {k} rows back needs back >= {k}, got {self.back}")

    def _over(self, rows: str = "") -> str:
        keys = ", ".join(f"`{k}`" for k in self.spec.block_keys)
        return f"OVER (PARTITION BY {keys} ORDER BY {ROW}{rows})"

    def _rolling(self, function: str, x: str, n: int) -> str:
        self._reaches(n - 1)
        return f"{function}({_sql(x)}) {self._over(f' ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW')}"

    def _lag(self, x: str, k: int) -> str:
        self._reaches(k)
        return f"lag({_sql(x)}, {k}) {self._over()}" if k else _sql(x)


def _sql(x: str) -> str:
    """A call stays as it is, a column name is quoted."""
    return x if "(" in x else f"`{x}`"
