"""Mixing sources to target weights by weighted fair queueing.

Every document waits in its source's queue, in an order shuffled by a hash of its id. Its
virtual finish time is the number of words its source has sent by then, divided by the
source's target; a second pass over the queue follows the first. All documents of all sources
are sorted by that time across the cluster and the mix takes them until the budget is spent.

Targets share the budget by weight; no target exceeds ``most`` times its source, and what a
source cannot take is shared by the others by weight, until none is above.

Queues are cut into hash buckets: running totals come from a window inside a bucket and one
over the bucket sums, so a source with a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.text import map_batches, slices, text_buffers, word_spans
from tidegauge.operators.ordered import running_totals
from tidegauge.session import materialise


def word_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words per whole text, 0 for null."""

    def emit(batch: pa.RecordBatch):
        offs, data = text_buffers(batch.column("text"))
        for lo, hi in slices(offs):
            part = offs[lo : hi + 1]
            yield {
                "doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()),
                "source": batch.column("source").slice(lo, hi - lo),
                "size": np.diff(word_spans(part - part[0], data[part[0] : part[-1]])[2]),
            }

    return map_batches(docs.select("doc_id", "source", "text"), emit, "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``(source, source_size, target)``, one row per source; sources by code point, null last, take the weights in turn."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn(
        "cap", (F.col("source_size") * most).cast("double")
    )
    # sources by the level at which they are full: before it they take by weight, after it their cap
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    later = filled.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything).cast("double") * share
    levels = weighed.withColumn("level", (budget - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(later))
    levels = levels.withColumn("place", F.row_number().over(filled))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("place", "level"))).over(everything)
    fits = first.getField("level")
    return levels.withColumn("target", F.least(F.col("cap"), F.coalesce(fits * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", digits: int = 3) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs(doc_id, source, text)``.

    ``taken`` is the number of words the mix takes of the row, repeats counted: 0, the size or
    twice the size (``most`` times at most). Null texts have size 0 and are never taken. A null
    source is a source of its own, the last one. Rows that repeat a ``doc_id`` queue one after
    the other; fully equal rows are interchangeable. An empty table gives an empty result.
    Equal inputs give equal mixes: the order depends on ids, sizes and ``seed`` only.
    """
    sizes = materialise(word_sizes(docs))
    targets = materialise(source_targets(sizes, weights, share, most))
    keyed = sizes.withColumn("_h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary")))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    per_bucket = keyed.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(F.col("source").alias("_src"), F.col("_b").alias("_bucket"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        keyed.withColumn("_run", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_bucket")))
        .withColumn("_end", F.col("_start") + F.col("_run"))
        .join(targets.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")))
        .select("doc_id", "source", "size", "source_size", "target", "_end")
    )
    queued = materialise(queued)
    passes = queued.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).where("size > 0 and target > 0")
    times = passes.select("size", ((F.col("_end") + F.col("_pass") * F.col("source_size")) / F.col("target")).alias("_at"))
    order = running_totals(times.groupBy("_at").agg(F.sum("size").alias("words")), [], "_at", ["words"])
    budget = targets.agg(F.sum("source_size").cast("double") * share).first()[0] or 0.0
    cut = order.where(F.col("words_before") + F.col("words") <= budget).agg(F.max("_at")).first()[0]
    taken = sum(
        (F.when((F.col("_end") + k * F.col("source_size")) / F.col("target") <= F.lit(cut), F.col("size")).otherwise(0) for k in range(most)),
        F.lit(0),
    )
    return queued.withColumn("taken", F.when((F.col("target") > 0) & F.lit(cut is not None), taken).otherwise(0).cast("long")).drop("_end")
