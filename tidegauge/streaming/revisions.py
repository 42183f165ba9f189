"""Bars of a tick stream that are corrected while ticks still arrive late.

Every micro-batch that touches a bar emits the bar again under the next revision number. A
tick is too late once the watermark (latest time seen by earlier micro-batches, less the
lateness) has reached the end of its bar; such ticks leave through the side output. Whether
a tick is too late depends on the watermark alone, never on what state is still held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: kinds of output rows; write them with ``partitionBy("kind")`` to have a table of each
REVISION, FINAL, LATE = "revision", "final", "late"

#: Spark drops rows behind the watermark before they reach a group. Times marked this many days
#: ahead, with a delay as much longer, give the same watermark and lose no row.
AHEAD = 50_000

_STATE = "open double, first decimal(38,0), high double, low double, close double, last decimal(38,0), volume double, n_ticks long, revision int"
ROWS_OF_STREAM = (
    "kind string, symbol string, ts timestamp, open double, high double, low double, close double, volume double, "
    "n_ticks long, revision int, tick_ts timestamp, tick_order decimal(38,0), price double"
)
_COLUMNS = [part.split()[0] for part in ROWS_OF_STREAM.split(", ")]
_COUNTS = {"n_ticks": "Int64", "revision": "Int64"}


def revised_bars(
    ticks: DataFrame,
    *,
    key: str,
    ts: str,
    price: str,
    order: Column,
    width: str = "1 hour",
    lateness: str = "2 hours",
    volume: Column | None = None,
) -> DataFrame:
    """Rows of three kinds from a stream of ticks.

    ``revision``: a bar as of this micro-batch, ``revision`` counting from 1; the highest one
    holds. ``final``: the last revision again, once the watermark has passed the bar. ``late``:
    a tick that came too late, with its time, order and price in ``tick_ts``, ``tick_order`` and
    ``price``, and the bar it belonged to in ``ts``.

    ``order`` is a whole number, unique within a bar. Ticks without a time or a price are left out;
    a null series is a series. State is one row per open bar and is dropped by a timer when the
    watermark passes, so it is bounded by the lateness. A group is the ticks of one bar in one
    micro-batch and streams through in Arrow batches, so a hot series is as many groups as it
    has bars. Event time is an instant: times without a zone are read in the session zone.
    """
    amount = F.lit(1.0) if volume is None else volume.cast("double")
    stamped = (
        ticks.withColumn(ts, F.col(ts).cast("timestamp"))
        .where(F.col(price).isNotNull() & F.col(ts).isNotNull())
        .select(
            F.col(key).cast("string").alias("symbol"),
            F.window(ts, width).alias("_w"),
            (F.col(ts) + F.make_dt_interval(F.lit(AHEAD))).alias("_t"),
            F.col(price).cast("double").alias("_p"),
            order.cast("decimal(38,0)").alias("_o"),
            amount.alias("_v"),
        )
        .select("symbol", F.unix_millis("_w.start").alias("_start"), F.unix_millis("_w.end").alias("_end"), "_t", "_p", "_o", "_v")
        .withWatermark("_t", f"{AHEAD} days {lateness}")
    )

    def bar(kind: str, symbol: str, start: int, held: tuple) -> pd.DataFrame:
        first, _, high, low, last, _, amount, n, revision = held
        at = pd.Timestamp(start, unit="ms")
        row = (kind, symbol, at, first, high, low, last, amount, n, revision, pd.NaT, None, float("nan"))
        return pd.DataFrame([row], columns=_COLUMNS).astype(_COUNTS)

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol, start, end = group
        over = end <= state.getCurrentWatermarkMs()
        held = state.get if state.exists else None
        if over:
            for frame in frames if not state.hasTimedOut else ():
                late = pd.DataFrame({"tick_ts": frame["_t"] - pd.Timedelta(days=AHEAD), "tick_order": frame["_o"], "price": frame["_p"]})
                late = late.assign(kind=LATE, symbol=symbol, ts=pd.Timestamp(start, unit="ms"))
                yield late.reindex(columns=_COLUMNS).astype(_COUNTS)
            if held is not None:
                state.remove()
                yield bar(FINAL, symbol, start, held)
            return
        for frame in frames:
            if frame.empty:
                continue
            lo, hi = frame["_o"].argmin(), frame["_o"].argmax()
            new = (frame["_p"].iloc[lo], frame["_o"].iloc[lo], frame["_p"].max(), frame["_p"].min(), frame["_p"].iloc[hi], frame["_o"].iloc[hi], frame["_v"].sum(), len(frame))
            if held is None:
                held = (*new, 0)
                continue
            opens = new[:2] if new[1] < held[1] else held[:2]
            closes = new[4:6] if new[5] > held[5] else held[4:6]
            held = (*opens, max(held[2], new[2]), min(held[3], new[3]), *closes, held[6] + new[6], held[7] + new[7], held[8])
        if held is None:
            return
        held = (*(float(x) if i in (0, 2, 3, 4, 6) else x for i, x in enumerate(held[:7])), int(held[7]), int(held[8]) + 1)
        state.update(held)
        state.setTimeoutTimestamp(int(end))
        yield bar(REVISION, symbol, start, held)

    return stamped.groupBy("symbol", "_start", "_end").applyInPandasWithState(update, ROWS_OF_STREAM, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_bars(rows: DataFrame) -> DataFrame:
    """The bars that hold, one row per series and step, from the stored rows of :func:`revised_bars`."""
    names = ["open", "high", "low", "close", "volume", "n_ticks", "revision"]
    best = F.max_by(F.struct(*names), "revision").alias("b")
    return rows.where(F.col("kind") == REVISION).groupBy("symbol", "ts").agg(best).select("symbol", "ts", *[f"b.{c}" for c in names])
