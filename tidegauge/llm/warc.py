"""WARC files of pages, and a Merkle audit of their replicas.

A shard file holds the records of one range of page ids, in order. Every record is hashed; a
node of the tree hashes an ordered range of ``FANOUT`` neighbours with their offsets, up to a
root per shard. The audit compares the roots of two replicas and descends into mismatching
branches only, level by level: a sound shard costs one row, a damaged record one row per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import materialise

FANOUT = 16
_START, _END = "WARC/1.1\r\n", "\r\n\r\n"


def warc_records(pages: DataFrame, per_shard: int = 4096) -> DataFrame:
    """``(shard, page_id, record)`` for every row of ``pages(page_id, url, html)``.

    Null ids form shard -1; null urls and pages are empty. Pages that contain a record start
    themselves are stored in base64.
    """
    body = F.coalesce("html", F.lit(""))
    coded = body.contains(_START)
    stored = F.when(coded, F.regexp_replace(F.base64(body.cast("binary")), "\\s", "")).otherwise(body)
    record = F.concat(
        F.lit(_START + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "%0A"),
        F.lit("\r\nContent-Type: text/html\r\n"),
        F.when(coded, F.lit("Content-Transfer-Encoding: base64\r\n")).otherwise(""),
        F.lit("Content-Length: "),
        F.octet_length(stored).cast("string"),
        F.lit("\r\n\r\n"),
        stored,
        F.lit(_END),
    )
    shard = F.coalesce(F.floor(F.col("page_id") / per_shard), F.lit(-1)).cast("long")
    return pages.select(shard.alias("shard"), "page_id", record.alias("record"))


def write_warc(records: DataFrame, path: str, replicas: dict[str, Column] | None = None) -> None:
    """One folder per shard with its records in order of id; the end of a record is the separator.

    ``replicas`` names versions of ``record``; each has a folder ``replica=<name>`` of its own,
    and one shuffle deals them all.
    """
    dealt = records.select("shard", "page_id", "record").repartition("shard")
    by = ["shard"]
    if replicas:
        by = ["replica", "shard"]
        versions = F.array(*(F.struct(F.lit(name).alias("replica"), record.alias("record")) for name, record in replicas.items()))
        dealt = dealt.select("shard", "page_id", F.inline(versions))
    lines = dealt.withColumn("record", F.regexp_replace("record", f"{_END}$", ""))
    ordered = lines.sortWithinPartitions(*by, "page_id", "record").drop("page_id")
    ordered.write.partitionBy(*by).option("lineSep", _END).option("compression", "gzip").mode("overwrite").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, page_id, url, html, record, sound)`` from files of ``write_warc``.

    ``sound`` is false where the length of the body is not the one that the header states.
    """
    raw = spark.read.option("lineSep", _START).schema("value string, shard long").text(path)
    rows = raw.where("value <> ''").withColumn("record", F.concat(F.lit(_START), "value"))
    head = F.substring_index("value", _END, 1)
    named = lambda name: F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    body = F.expr(f"substring(value, length(substring_index(value, '{_END}', 1)) + 5, length(value))".replace("\r", "\\r").replace("\n", "\\n"))
    rows = rows.withColumns({"_head": head, "_b": body}).withColumn("_b", F.expr("left(_b, greatest(length(_b) - 4, 0))"))
    plain = F.when(named("Content-Transfer-Encoding") == "base64", F.unbase64("_b").cast("string")).otherwise(F.col("_b"))
    return rows.select(
        "shard",
        F.regexp_extract(head, r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        named("WARC-Target-URI").alias("url"),
        plain.alias("html"),
        "record",
        (F.octet_length("_b") == named("Content-Length").try_cast("long")).alias("sound"),
    )


def leaves(records: DataFrame, *by: str) -> DataFrame:
    """``(by, shard, idx, page_id, offset, length, sha256)``: records by place in their shard."""
    hashed = records.select(*by, "shard", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"))
    order = Window.partitionBy(*by, "shard").orderBy("page_id", "sha256")
    return hashed.select(
        *by,
        "shard",
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        "page_id",
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        "length",
        "sha256",
    )


def merkle_levels(leaf: DataFrame, *by: str, per_shard: int = 4096) -> list[DataFrame]:
    """Stored node tables ``(by, shard, idx, sha256)`` from the leaves to one root per shard."""
    nodes = leaf.select(*by, "shard", "idx", F.sha2(F.concat_ws(":", "offset", "length", "sha256"), 256).alias("sha256"))
    levels, reach = [nodes], 1
    while reach < per_shard * FANOUT:
        named = F.transform(F.array_sort(F.collect_list(F.struct("idx", "sha256"))), lambda x: F.concat_ws(":", x["idx"].cast("string"), x["sha256"]))
        parent = F.floor(F.col("idx") / FANOUT).alias("idx")
        nodes = materialise(nodes.groupBy(*by, "shard", parent).agg(F.sha2(F.concat_ws(",", named), 256).alias("sha256")))
        levels.append(nodes)
        reach *= FANOUT
    return levels


def audit(levels: list[DataFrame]) -> DataFrame:
    """``(shard, idx)`` of the leaves that differ between the two replicas, or that one lacks."""
    suspects = None
    for nodes in reversed(levels):
        if suspects is not None:
            parent = (F.col("shard") == F.col("_shard")) & (F.floor(F.col("idx") / FANOUT) == F.col("_idx"))
            nodes = nodes.join(suspects.select(F.col("shard").alias("_shard"), F.col("idx").alias("_idx")), parent, "left_semi")
        seen = nodes.groupBy("shard", "idx").agg(F.count("*").alias("n"), F.min("sha256").alias("low"), F.max("sha256").alias("high"))
        suspects = seen.where("n < 2 or low <> high").select("shard", "idx")
    return suspects


def audit_replica(ours: DataFrame, theirs: DataFrame, per_shard: int = 4096) -> DataFrame:
    """``(page_id, shard, offset, length, sha256, damaged)`` for every record of ``ours``.

    ``damaged``: the other replica's record at that place differs or is missing. Records that
    only the other replica has are not listed. Fully equal records of one id may stand for
    each other. Empty replicas give an empty result.
    """
    columns = ["shard", "page_id", "record"]
    both = ours.select(F.lit(True).alias("ours"), *columns).unionByName(theirs.select(F.lit(False).alias("ours"), *columns))
    leaf = materialise(leaves(both, "ours"))
    bad = audit(merkle_levels(leaf, "ours", per_shard=per_shard)).withColumn("damaged", F.lit(True))
    rows = leaf.where("ours").join(bad, ["shard", "idx"], "left")
    return rows.select("page_id", "shard", "offset", "length", "sha256", F.coalesce("damaged", F.lit(False)).alias("damaged"))
