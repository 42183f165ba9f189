"""Registered queries of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bpe import Vocabulary, encode_texts
from tidegauge.llm.chat import digests, format_conversations
from tidegauge.llm.decontaminate import find_contaminated
from tidegauge.llm.embedding_dedup import near_vectors
from tidegauge.llm.hmm import score_texts
from tidegauge.llm.infill import infill_digests
from tidegauge.llm.language import identify, train_language
from tidegauge.llm.lexical_search import search_documents
from tidegauge.llm.mixing import mix_sources
from tidegauge.llm.ngram_join import jaccard_components
from tidegauge.llm.quality import score_quality, train_quality
from tidegauge.llm.substring_dedup import removal_digests
from tidegauge.llm.text import crc_fold
from tidegauge.llm.warc import audit_replica, read_warc, warc_records, write_warc
from tidegauge.session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 5-word shingles at a similarity of 0.75."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain items of the benchmark."""
    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources at weights 3, 1, 2, for 150 % of all words."""
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, encoded and masked, read back from the output."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(extra)))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of all pages as WARC files, one with every 89th record damaged, audited by Merkle trees."""
    records = warc_records(_table(spark, sf_dir, "pages"))
    damaged = F.when(F.pmod("page_id", F.lit(89)) == 7, F.regexp_replace("record", "text/html", "text/htmX")).otherwise(F.col("record"))
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_warc(records, folder, {"a": F.col("record"), "b": damaged})
    return audit_replica(read_warc(spark, f"{folder}/replica=a"), read_warc(spark, f"{folder}/replica=b"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = train_language(docs, crc_fold("doc_id", 3) != 1)
    return identify(docs, model).withColumn("held_out", crc_fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors of equal label at a cosine of 0.93."""
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the hidden Markov model and under word counts."""
    scored = score_texts(_table(spark, sf_dir, "documents"), F.coalesce(crc_fold("doc_id", 7) != 2, F.lit(False)))
    return scored.withColumn("held_out", crc_fold("doc_id", 7) == 2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without the 50-word passages that an earlier one has."""
    return removal_digests(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = train_quality(docs, _table(spark, sf_dir, "labels"), crc_fold("doc_id", 4) != 2)
    scored = score_quality(docs, model).withColumn("held_out", crc_fold("doc_id", 4) == 2)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for infilling, with digests of the output and of the text restored from it."""
    return infill_digests(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word vocabulary."""
    import public_tokenizers

    vocabulary = Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    coded = encode_texts(_table(spark, sf_dir, "documents"), vocabulary, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_chat": op4_chat,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_language": op6_language,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_bpe": op13_bpe,
}
