"""Tables on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Snappy parquet, optionally in one folder per partition value."""
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_external(external: DataFrame, path: str, mode: str = "append") -> str:
    """External series in one folder per source."""
    return write_table(external, path, ["source"], mode)


def write_sequences(windows: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Sequence windows by split, ready for :func:`read_split`."""
    return write_table(windows, path, ["split"], mode)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a stored tabular or sequence dataset; other folders are not opened."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_summary(summary: DataFrame, path: str) -> str:
    """A summary table as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_scaler(scaler: DataFrame, path: str) -> str:
    return write_table(scaler, path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
