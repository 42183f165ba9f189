"""From raw documents to a training mix, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.decontaminate import drop_contaminated
from tidegauge.llm.mixing import mix_sources
from tidegauge.llm.ngram_join import jaccard_components
from tidegauge.llm.quality import keep_quality, train_quality
from tidegauge.llm.substring_dedup import without_repeats
from tidegauge.llm.text import crc_fold, hash_bits, where_marked
from tidegauge.session import brief_shuffles, materialise, prepare

ROW_KEY, ONCE = "_pipeline_row", "_pipeline_once"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; null and empty texts are scored like any other, repeats alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, train_quality(docs, labels, crc_fold("doc_id", 4) != 2), 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: that of the smallest ``doc_id`` (nulls last), then of the smallest row hash.

    Rows are told apart by a hash of all their columns, so ids may be null or repeated; of
    wholly equal rows that share a group one stays. Texts without words are in no group and stay.
    """
    keyed = docs.withColumn(ROW_KEY, F.xxhash64(*docs.columns))
    rows = keyed.select(F.col(ROW_KEY).alias("key"), F.col("doc_id").alias("id"))
    groups = jaccard_components(keyed.select(F.col(ROW_KEY).alias("doc_id"), "text")).where("n_shingles > 0")
    with brief_shuffles(spark):
        placed = materialise(groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).join(rows.distinct(), "key"))
        several = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best"))
        several = placed.join(several.where("n > 1"), "group")
        gone = several.where("key <> best.key").select("key", F.lit(False).alias("once")).distinct()
        again = several.where("key = best.key").groupBy("key").agg((F.count(F.lit(1)) > 1).alias("once")).where("once")
        watched = materialise(gone.unionAll(again))
        bits = hash_bits(watched.select("key"), 24)
    watched = watched.select(F.col("key").alias(ROW_KEY), F.col("once").alias(ONCE))
    near = where_marked(keyed, ROW_KEY, bits, True).join(watched, ROW_KEY, "left")
    kept = near.where(F.col(ONCE).isNull()).unionAll(near.where(F.col(ONCE)).dropDuplicates([ROW_KEY]))
    return where_marked(keyed, ROW_KEY, bits, False).select(*docs.columns).unionAll(kept.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that a document with a smaller id has; rows without id stay whole."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark items; each row is judged by its own text, null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words it takes of each; texts without words take none and go."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: Models and similarity stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
