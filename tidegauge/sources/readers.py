"""Landed files to bar and external tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = logging.getLogger(__name__)

# fixed values: header of a raw bar file
BAR_HEADER = ("Datetime", "Open", "High", "Low", "Close", "Volume")
# fixed values: accepted headers of a sentiment file, lower case
DATE_HEADERS = ("date", "datetime")
VALUE_HEADERS = ("fear_greed", "value", "score")
# fixed values: days from value date to release by frequency
RELEASE_LAGS = {"daily": 1, "weekly": 5, "monthly": 30}
EXTERNAL_SCHEMA = "value_date timestamp, release_date timestamp, value double"


def _bar_text(spark: SparkSession, path: str | list[str], corrupt: str | None) -> DataFrame:
    """The text columns of bar files; ``corrupt`` names a column for lines with too few or too many fields."""
    files = spark.read.option("header", True).option("recursiveFileLookup", True)
    columns = files.csv(path).columns
    missing = [c for c in BAR_HEADER if c not in columns]
    if missing:
        raise ValueError(f"bar file lacks columns {missing}")
    fields = [f"`{c}` string" for c in columns]
    # a file whose header differs from that of the first one is an error in either mode
    files = files.option("enforceSchema", False)
    if corrupt is None:
        return files.option("mode", "FAILFAST").schema(", ".join(fields)).csv(path)
    files = files.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    return files.schema(", ".join([*fields, f"`{corrupt}` string"])).csv(path)


def _bar_time(zone: str) -> Column:
    """The text of a time with its zone, so that its instant does not depend on the session."""
    text = F.trim(F.col("Datetime"))
    day = text.rlike(r"^\d+-\d+-\d+$")
    offset = ~day & text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(offset, text).when(day, F.concat(text, F.lit(f" 00:00:00 {zone}"))).otherwise(F.concat(text, F.lit(f" {zone}")))


def _named(symbol: str | Column) -> Column:
    return (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol")


def read_bars_csv(spark: SparkSession, path: str | list[str], symbol: str | Column, zone: str = "UTC") -> DataFrame:
    """Bars from CSV files; a missing header, a malformed line or an unreadable time is an error.

    Times without an offset are taken in ``zone``; times with one keep their instant.
    ``symbol`` is a name, or a column over ``_metadata.file_path`` where folders name the series.
    """
    found = _bar_text(spark, path, None)
    return found.select(
        _named(symbol),
        F.to_timestamp(_bar_time(zone)).alias("ts"),
        *[F.col(c).cast("double").alias(c.lower()) for c in BAR_HEADER[1:]],
    )


def sift_bars_csv(spark: SparkSession, path: str | list[str], symbol: str | Column, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """``(bars, rejected)``: the readable bars, and every other line with its file and the first reason against it.

    ``rejected`` has ``symbol, file, record, reason``. Empty values are missing, not malformed.
    Each of the two scans the files when it is used.
    """
    found = _bar_text(spark, path, "_line")
    stamp = F.try_to_timestamp(_bar_time(zone))
    numbers = {c: F.expr(f"try_cast(trim(`{c}`) AS double)") for c in BAR_HEADER[1:]}
    reason = F.when(F.col("_line").isNotNull(), "wrong number of fields")
    reason = reason.when(F.col("Datetime").isNull(), "no time").when(stamp.isNull(), "unreadable time")
    for c, value in numbers.items():
        reason = reason.when(F.col(c).isNotNull() & value.isNull(), f"unreadable {c.lower()}")
    record = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in found.columns if c != "_line"]))
    rows = found.select(
        _named(symbol),
        F.col("_metadata.file_path").alias("file"),
        record.alias("record"),
        reason.alias("reason"),
        stamp.alias("ts"),
        *[v.alias(c.lower()) for c, v in numbers.items()],
    )
    bars = rows.where("reason is null").select("symbol", "ts", *[c.lower() for c in BAR_HEADER[1:]])
    return bars, rows.where("reason is not null").select("symbol", "file", "record", "reason")


def read_external_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All ``macro_*`` and ``sentiment_*`` parquet entries of a folder in long form.

    The name without the prefix becomes ``source``. Columns are resolved by name, so files
    that carry a keyword give one source per keyword. Nanosecond times, which pandas writes
    by default, are read as numbers and cut to microseconds, in a session of their own, so
    that other reads keep their types.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    files = own.read.option("mergeSchema", True).option("recursiveFileLookup", True)
    raw = files.parquet(f"{folder}/{{macro,sentiment}}_*.parquet")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:macro|sentiment)_([^/]+?)\.parquet", 1)
    if "keyword" in raw.columns:
        name = F.when(F.col("keyword").isNotNull(), F.concat_ws(":", name, "keyword")).otherwise(name)
    dates = [
        (F.timestamp_micros(F.floor(F.col(c) / 1000)) if dict(raw.dtypes)[c] == "bigint" else F.col(c)).alias(c)
        for c in ("value_date", "release_date")
    ]
    return raw.select(name.alias("source"), *dates, F.col("value").cast("double").alias("value"))


def read_external_table(spark: SparkSession, path: str) -> DataFrame:
    """External series as ``write_external`` stores them; unread sources are not opened."""
    return spark.read.parquet(path).select(F.col("source").cast("string").alias("source"), "value_date", "release_date", "value")


def read_sentiment_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment file with a loosely named header; released on its value date."""
    raw = spark.read.option("header", True).csv(path)
    date = next((c for c in raw.columns if c.lower() in DATE_HEADERS), None)
    value = next((c for c in raw.columns if c.lower() in VALUE_HEADERS), None)
    if date is None or value is None:
        raise ValueError(f"no date or value column among {raw.columns}")
    stamp = F.to_timestamp(F.col(date))
    return raw.select(
        stamp.alias("value_date"), stamp.alias("release_date"), F.col(value).cast("double").alias("value")
    )


def read_sentiment_json(spark: SparkSession, path: str) -> DataFrame:
    """Payload ``{"data": [{"timestamp": "<epoch seconds>", "value": "<number>"}]}``."""
    if "data" not in spark.read.option("multiLine", True).json(path).columns:
        raise ValueError("payload has no data list")
    schema = "data array<struct<timestamp:string,value:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("data"))
    stamp = F.timestamp_seconds(F.col("timestamp").cast("bigint"))
    return raw.select(
        stamp.alias("value_date"), stamp.alias("release_date"), F.col("value").cast("double").alias("value")
    )


def first_available(spark: SparkSession, attempts: Sequence[tuple[Callable[[SparkSession, str], DataFrame], str]]) -> DataFrame:
    """The first source that can be opened; an empty external frame if none can.

    Every failed attempt is logged as a warning with its path and reason.
    """
    for read, path in attempts:
        try:
            return read(spark, path)
        except (AnalysisException, ValueError) as reason:
            _LOG.warning("%s could not be read: %s", path, reason)
    return spark.createDataFrame([], EXTERNAL_SCHEMA)


def keywords_long(wide: DataFrame, keywords: Sequence[str], date: str = "date") -> DataFrame:
    """One column per keyword to ``(value_date, release_date, keyword, value)``."""
    typed = wide.select(F.col(date).alias("value_date"), *[F.col(k).cast("double").alias(k) for k in keywords])
    long = typed.unpivot(["value_date"], list(keywords), "keyword", "value").where(F.col("value").isNotNull())
    return long.select("value_date", F.col("value_date").alias("release_date"), "keyword", "value")


def stamp_release(external: DataFrame, frequency: Mapping[str, str], lags: Mapping[str, int] | None = None) -> DataFrame:
    """Add ``release_date``: value date plus calendar days, by frequency or per source.

    Lags are at least the true delay of the source, or the alignment would look ahead: a
    monthly figure stamped at the start of its month needs about 45 days.
    """
    lags = lags or {}
    unknown = sorted(set(frequency.values()) - set(RELEASE_LAGS))
    if unknown:
        raise ValueError(f"unknown frequencies {unknown}")
    days = {s: lags.get(s, RELEASE_LAGS[f]) for s, f in frequency.items()}
    lookup = F.create_map(*[F.lit(v) for pair in days.items() for v in pair])
    # a source without a known delay can not be aligned; it fails the job
    unlisted = F.raise_error(F.concat(F.lit("no release lag is known for source "), F.coalesce("source", F.lit("NULL"))))
    lag = F.coalesce(F.element_at(lookup, F.col("source")) if days else F.lit(None).cast("int"), unlisted.cast("int"))
    stamp = F.col("value_date") + F.make_dt_interval(lag)
    return external.select("source", "value_date", stamp.alias("release_date"), "value")
