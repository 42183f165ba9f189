"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
ARROW_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone, bound Arrow batches and make sure a durable checkpoint folder is known.

    Batches for Python tasks are bounded by bytes (4 MB unless the session says otherwise),
    because rows of text differ in size by orders of magnitude.

    The folder comes from ``spark.checkpoint.dir``. Only a local master may fall back
    to a scratch folder, because executors elsewhere could not read it.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(ARROW_BYTES_KEY, None) is None:
        spark.conf.set(ARROW_BYTES_KEY, str(4 << 20))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(shared)
    return spark


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Used where a frame feeds several branches: the branches then read the stored rows
    instead of running the whole lineage again, and lost executors cost a re-read only.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames made inside go as soon as the action that wrote them ends.

    Else they stay until the driver happens to collect its garbage, so that a chain of
    materialised steps holds the shuffles of all of them, and the more the larger the input.
    A frame that is run twice writes its shuffles again, and so does one read by
    ``toLocalIterator``; such frames and those to return are made outside.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once per context.

    The sources go to the executors through the context's own file service, so nothing has
    to be installed on them.
    """
    context = spark.sparkContext
    if getattr(context, "_tidegauge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tidegauge_src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidegauge_shipped = True
