"""The driver tables in the roles of ticks, external series and predictions.

* ``events``: ticks of hourly bars, one series per event type;
* ``lineitem``: ticks of daily bars, one series per return flag;
* ``orders``: daily external series, one per priority, released with a lag.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.target import target_stages, ternary
from tidegauge.functions.technical import log_returns
from tidegauge.operators.bars import arrival_order, build_bars
from tidegauge.operators.blocks import ROW, ROWS, Blocked, SeriesSpec, index_rows
from tidegauge.session import materialise, prepare
from tidegauge.sources.readers import stamp_release
from tidegauge.streaming.revisions import ROWS_OF_STREAM, revised_bars

HOURLY = SeriesSpec(bar_seconds=3600)
DAILY = SeriesSpec(bar_seconds=86400)

# fixed values: external source per order priority, and its publication frequency
SOURCE_OF = {
    "1-URGENT": "dxy",
    "2-HIGH": "us10y_yield",
    "3-MEDIUM": "vix",
    "4-NOT SPECIFIED": "order_flow",
    "5-LOW": "fear_greed",
}
FREQUENCY = {
    "dxy": "daily",
    "us10y_yield": "weekly",
    "vix": "daily",
    "order_flow": "monthly",
    "fear_greed": "daily",
}
SOURCES = tuple(FREQUENCY)
LAG_OVERRIDE = {"order_flow": 14}

#: horizon of the derived predictions, in bars
HORIZON = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_bars(
        table(spark, sf_dir, "events"),
        key="event_type",
        ts="ts",
        price="value",
        order=F.col("event_id"),
    )


def replayed_bars(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """Stored rows of a stream that receives the ticks out of order, in micro-batches of equal time.

    Ticks arrive up to two hours late, every third up to three days. The query ends after every
    micro-batch and goes on from its checkpoint.
    """
    ticks = table(spark, sf_dir, "events").where("ts is not null and value is not null")
    delay = F.when(F.col("event_id") % 3 == 1, F.col("event_id") * 7919 % 259200).otherwise(F.col("event_id") * 104729 % 7200)
    arrival = (F.unix_micros(F.col("ts").cast("timestamp")) + delay * 1000000).alias("arrival")
    arrived = ticks.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value", arrival)
    span = arrived.agg(F.min("arrival").alias("first"), F.max("arrival").alias("last")).first()
    folder = f"{spark.sparkContext.getCheckpointDir()}/replay-{uuid.uuid4().hex}"
    schema = "event_id long, event_type string, ts timestamp, value double"
    for batch in range(batches if span.first is not None else 0):
        due = F.floor((F.col("arrival") - span.first) * batches / (span.last - span.first + 1)) == batch
        part = arrived.where(due).select(F.col("event_id").cast("long"), "event_type", "ts", F.col("value").cast("double"))
        part.write.mode("append").parquet(f"{folder}/ticks")
        rows = revised_bars(spark.readStream.schema(schema).parquet(f"{folder}/ticks"), key="event_type", ts="ts", price="value", order=F.col("event_id"), lateness="4 hours")
        sink = rows.writeStream.format("parquet").partitionBy("kind").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    if span.first is None:
        return spark.createDataFrame([], ROWS_OF_STREAM)
    return spark.read.schema(ROWS_OF_STREAM).parquet(f"{folder}/rows")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    # order and line repeat, but rows that also agree in price give the same open and close
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100)
    return build_bars(
        table(spark, sf_dir, "lineitem"),
        key="l_returnflag",
        ts="l_shipdate",
        price="l_extendedprice",
        order=arrival_order((line, 19), (cents, 12)),
        width="1 day",
        volume=F.col("l_quantity"),
    )


def external_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, value_date, value)``: daily order volume per priority."""
    names = F.create_map(*[F.lit(v) for pair in SOURCE_OF.items() for v in pair])
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.element_at(names, F.col("o_orderpriority")).alias("source"), F.col("o_orderdate").alias("value_date"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp_release(external_values(spark, sf_dir), FREQUENCY, LAG_OVERRIDE)


def stored_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(daily_bars(spark, sf_dir))


def stored_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(hourly_bars(spark, sf_dir))


def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with their row numbers."""
    return index_rows(stored_daily(spark, sf_dir).drop("n_ticks"), DAILY)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily forecasts that lean against the past return, with labels and probabilities.

    Rows without an outcome or a forecast keep NULLs.
    """
    past = f"logret_{HORIZON}"
    b = Blocked.of(daily_index(spark, sf_dir), DAILY, back=26, ahead=HORIZON)
    b = b.run(log_returns(b, (HORIZON,)), target_stages(b, HORIZON))
    up, flat, down = F.exp(-F.col(past)), F.lit(1.0), F.exp(F.col(past))
    total = up + flat + down
    return b.home().select(
        "symbol",
        "ts",
        ROW,
        ROWS,
        "close",
        F.col(f"y_reg_h{HORIZON}").alias("y_true"),
        (-0.5 * F.col(past)).alias("y_pred"),
        F.col(f"y_clf_h{HORIZON}").alias("c_true"),
        ternary(-0.5 * F.col(past), F.col("y_clf_threshold")).alias("c_pred"),
        F.round(down / total, 3).alias("p_neg"),
        F.round(flat / total, 3).alias("p_neu"),
        F.round(up / total, 3).alias("p_pos"),
    )


def labels(preds: DataFrame) -> DataFrame:
    """The classification view of :func:`predictions`."""
    return preds.drop("y_true", "y_pred").withColumnsRenamed({"c_true": "y_true", "c_pred": "y_pred"})


def damaged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with faults by day of month: repeats, broken highs and lows, gaps in close."""
    bars = daily_bars(spark, sf_dir)
    day = F.dayofmonth("ts")
    broken = bars.withColumns(
        {
            "high": F.when(day == 2, F.col("low") - 1.0).otherwise(F.col("high")),
            "low": F.when(day == 3, F.col("high") + 1.0).otherwise(F.col("low")),
            "close": F.when(day != 4, F.col("close")),
        }
    )
    return broken.unionByName(broken.where(day == 1))
