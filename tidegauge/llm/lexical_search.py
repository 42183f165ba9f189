"""Ranked lexical search over bit-sliced Bloom signatures.

``sign_documents`` stores one row per block of documents. A document's signature is a Bloom
filter of its terms, once for each occurrence level it reaches (1, 2, 4 and 8 times); its width
follows from its number of entries, and documents of one width share blocks of ``BLOCK_BITS``
bits. A block is stored by slices: for each bit position the bits of all its documents.

``search_documents`` ANDs the slices of a term to bitmaps of the documents that may hold it at
each level. Sums of term weights over those bitmaps, times the largest score a level allows at the
document's length, bound every score from above. Queries go in blocks of bounded size:

1. exact document frequencies of the block's terms, summed over all texts;
2. for every query the ``PROBES`` documents of the highest bounds are scored exactly, and the
   ``top``-th of these scores is a bound from below;
3. every document whose upper bound reaches it is scored exactly, and the best are kept.

No document is left out unless its bound proves it. Texts are read where they lie; candidates
travel as (query, row key) pairs, and each task keeps its best ``top`` rows of a query before
they are shuffled. Sizes and totals are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.text import Words, hash_bits, int_column, map_batches, mix64, pack, sliced_words, text_buffers, unpack, where_marked, words_of
from tidegauge.llm.vectors import summed
from tidegauge.session import materialise, ship_package

LEVELS = (1, 2, 4, 8)
HASHES = 3
BITS_PER_ENTRY = 8
BLOCK_BITS = 1 << 22
PROBES = 64
_U = np.uint64
_SIGNED = "width int, keys array<long>, sizes array<long>, slices binary"


def places(names: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bit positions of terms at a level, one row per hash."""
    step = [mix64(names + _U((level * HASHES + h + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for h in range(HASHES)]
    return np.stack([x & _U(width - 1) for x in step]).astype(np.int64)


def term_counts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, name and number of occurrences of every distinct term of a text."""
    of = words.text_of()
    order = np.lexsort((words.name, of))
    of, name = of[order], words.name[order]
    first = np.ones(len(of), dtype=bool)
    first[1:] = (of[1:] != of[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(first)
    return of[at], name[at], np.diff(np.append(at, len(of)))


def row_key():
    """Names a row by id and text; rows that share a key are only scored together."""
    return F.xxhash64("doc_id", "text")


def sign_documents(docs: DataFrame) -> DataFrame:
    """Signature blocks of all rows of ``docs(doc_id, text)``; rows without terms have none.

    Null and empty texts have no terms. Other columns are not looked at.
    """
    ship_package(docs.sparkSession)

    def block(width: int, held: list) -> dict:
        bits = np.zeros((width, -(-len(held) // 8) * 8), dtype=bool)
        for column, (_, _, entries) in enumerate(held):
            for level, names in entries:
                bits[places(names, level, width).ravel(), column] = True
        return {
            "width": [width],
            "keys": [[key for key, _, _ in held]],
            "sizes": [[size for _, size, _ in held]],
            "slices": [pack(np.packbits(bits, axis=1))],
        }

    schema = pa.schema([("width", pa.int32()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list] = {}
        for batch in batches:
            keys = int_column(batch, "key")
            for lo, _, words in sliced_words(batch.column("text"), lower=True, plain=True):
                of, name, times = term_counts(words)
                sizes, bounds = words.counts, np.searchsorted(of, np.arange(len(words.bounds)))
                for t in np.flatnonzero(sizes).tolist():
                    a, b = bounds[t], bounds[t + 1]
                    entries = [(level, name[a:b][times[a:b] >= level]) for level in LEVELS]
                    width = max(64, 1 << (BITS_PER_ENTRY * sum(len(x) for _, x in entries) - 1).bit_length())
                    held = open_blocks.setdefault(width, [])
                    held.append((int(keys[lo + t]), int(sizes[t]), [(level, x.copy()) for level, x in entries if len(x)]))
                    if len(held) * width >= BLOCK_BITS:
                        yield pa.RecordBatch.from_pydict(block(width, open_blocks.pop(width)), schema=schema)
        for width, held in open_blocks.items():
            yield pa.RecordBatch.from_pydict(block(width, held), schema=schema)

    return docs.select(row_key().alias("key"), "text").mapInArrow(run, _SIGNED)


@dataclass(frozen=True)
class Queries:
    """A block of queries: distinct terms, and each query's terms as places among them."""

    ids: list
    names: np.ndarray  # sorted
    terms: list[np.ndarray]
    weights: np.ndarray
    total: int
    words: int

    def span(self, sizes: np.ndarray) -> np.ndarray:
        """The length ``m`` of documents of ``sizes`` terms in the score."""
        return 10 + 90 * sizes * self.total // self.words


def share(times: np.ndarray | int, span: np.ndarray) -> np.ndarray:
    """Score of one unit of weight for a term that occurs ``times`` times; grows with ``times``."""
    return 1_000_000_000 * times // (1000 * times + 8 * span)


def bounds_of(queries: Queries, width: int, sizes: np.ndarray, slices: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds of the scores of a block's documents, for each query in turn."""
    n = len(sizes)
    slices = slices.reshape(width, -1)
    may = []
    for level in LEVELS:
        at = places(queries.names, level, width)
        held = slices[at[0]]
        for h in range(1, HASHES):
            held = held & slices[at[h]]
        may.append(held if not may else held & may[-1])
    span = queries.span(sizes)
    # a term that may reach a level but not the next one occurs at most once less than the next
    caps = [share(level - 1, span) for level in LEVELS[1:]] + [share(sizes, span)]
    gains = [caps[0]] + [np.maximum(b - a, 0) for a, b in zip(caps, caps[1:])]
    alive = [m.any(axis=1) for m in may]
    for q, terms in enumerate(queries.terms):
        bound = np.zeros(n, dtype=np.int64)
        for m, live, gain in zip(may, alive, gains):
            there = terms[live[terms]]
            if not len(there):
                break
            sums = queries.weights[there].astype(np.float64) @ np.unpackbits(m[there], axis=1, count=n)
            bound += sums.astype(np.int64) * gain
        yield q, bound


def exact_scores(queries: Queries, words: Words, wanted: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of the wanted queries for each text of ``words``."""
    of, name, times = term_counts(words)
    place = np.searchsorted(queries.names, name)
    place[place == len(queries.names)] = 0
    hit = queries.names[place] == name
    of, place, times = of[hit], place[hit], times[hit]
    bounds = np.searchsorted(of, np.arange(len(wanted) + 1))
    span, out = queries.span(words.counts), []
    for t, asked in enumerate(wanted):
        value = np.zeros(len(queries.names), dtype=np.int64)
        a, b = bounds[t], bounds[t + 1]
        value[place[a:b]] = queries.weights[place[a:b]] * share(times[a:b], span[t])
        out.append(np.array([value[queries.terms[q]].sum() for q in asked.tolist()], dtype=np.int64))
    return out


def _query_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Queries and their distinct terms, in blocks of about ``block_bytes`` of text."""
    held, last, size = [], object(), 0
    for row in items.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        offs, data = text_buffers(pa.array([row.text]))
        names = np.unique(words_of(offs, data, lower=True, plain=True).name)
        if not len(names):
            continue
        if row.item_id == last and held:
            held[-1] = (last, np.union1d(held[-1][1], names))
        else:
            if size > block_bytes:
                yield held
                held, size = [], 0
            held.append((row.item_id, names))
        last, size = row.item_id, size + len(row.text) + 1
    if held:
        yield held


def _frequencies(docs: DataFrame, names: np.ndarray) -> np.ndarray:
    """Number of rows that hold each of the sorted ``names``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            for _, _, words in sliced_words(batch.column("text"), lower=True, plain=True):
                place = np.searchsorted(names, words.name)
                place[place == len(names)] = 0
                hit = names[place] == words.name
                pairs = np.unique(words.text_of()[hit] * len(names) + place[hit])
                out += np.bincount(pairs % len(names), minlength=len(names))
        return out

    return summed(docs.select("text"), fold, len(names), np.int64)


def _candidates(signed: DataFrame, shared, floors: np.ndarray | None, probes: int) -> DataFrame:
    """``(query, key, bound)``: rows that reach their query's floor, or each task's ``probes`` best without floors."""
    schema = pa.schema([("query", pa.int32()), ("key", pa.int64()), ("bound", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in queries.ids]
        for batch in batches:
            for row in batch.to_pylist():
                width, sizes, keys = row["width"], np.array(row["sizes"], dtype=np.int64), np.array(row["keys"], dtype=np.int64)
                slices = unpack(row["slices"], width * -(-len(sizes) // 8), np.uint8)
                found = []
                for q, bound in bounds_of(queries, width, sizes, slices):
                    at = np.flatnonzero(bound >= floors[q] if floors is not None else bound > 0)
                    if floors is not None:
                        found.append((np.full(len(at), q, dtype=np.int32), keys[at], bound[at]))
                    elif len(at):
                        bounds, held = np.append(best[q][0], bound[at]), np.append(best[q][1], keys[at])
                        keep = np.lexsort((held, -bounds))[:probes]
                        best[q] = bounds[keep], held[keep]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=schema)
        if floors is None:
            for q, (bounds, held) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), q, dtype=np.int32)), pa.array(held), pa.array(bounds)], schema=schema)

    return signed.mapInArrow(run, "query int, key long, bound long")


def _scored(docs: DataFrame, pairs: DataFrame, shared, top: int) -> DataFrame:
    """``(query, doc_id, score)``: exact scores of the rows of the candidate pairs, each task's best ``top`` of a query.

    Only rows whose key may be a candidate's (a bit map of fixed size) meet the pairs in a join.
    """
    keyed = docs.select("doc_id", row_key().alias("key"), "text")
    asked = pairs.groupBy("key").agg(F.collect_set("query").alias("queries"))
    near = where_marked(keyed, "key", hash_bits(pairs.select("key"), 24), True)
    rows = near.join(asked, "key").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "queries")
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best: dict[int, list[tuple[int, float, object]]] = {}
        for batch in batches:
            ids, wanted = batch.column("doc_id").to_pylist(), [np.array(x, dtype=np.int64) for x in batch.column("queries").to_pylist()]
            for lo, hi, words in sliced_words(batch.column("text"), lower=True, plain=True):
                for t, scores in enumerate(exact_scores(queries, words, wanted[lo:hi]), lo):
                    for q, score in zip(wanted[t].tolist(), scores.tolist()):
                        if score > 0:
                            best.setdefault(q, []).append((-score, math.inf if ids[t] is None else ids[t], ids[t]))
            for q, held in best.items():
                if len(held) > top:
                    held.sort(key=lambda x: x[:2])
                    del held[top:]
        flat = [(q, doc_id, -score) for q, held in best.items() for score, _, doc_id in held]
        columns = list(zip(*flat)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_documents(docs: DataFrame, items: DataFrame, top: int = 10, probes: int = PROBES, block_bytes: int = 1 << 20) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` highest-scoring rows of ``docs`` for each item.

    Rows with equal scores stand by ascending ``doc_id``, null ids last; rows that score 0 are
    left out, so null and empty texts never appear. Every row of ``docs(doc_id, text)`` counts as
    a document of its own, repeated ids and texts included. Rows of ``items(item_id, text)`` that
    share an id are one query of all their terms; null and empty items have no results. Other
    columns are not looked at. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    signed = materialise(sign_documents(docs))
    facts = signed.select(F.size("keys").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    total, length = facts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not total:
        return result
    for block in _query_blocks(items, block_bytes):
        names = np.unique(np.concatenate([terms for _, terms in block]))
        seen = _frequencies(docs, names)
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in seen.tolist()], dtype=np.int64)
        queries = Queries([q for q, _ in block], names, [np.searchsorted(names, terms) for _, terms in block], weights, total, length)
        shared = spark.sparkContext.broadcast(queries)
        probed = _candidates(signed, shared, None, probes)
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "key")
        probed = materialise(probed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= probes).drop("place"))
        floors = np.ones(len(block), dtype=np.int64)
        for row in _ranked(_scored(docs, probed, shared, top), top).where(F.col("rank") == top).toLocalIterator():
            floors[row["query"]] = row.score
        pairs = materialise(_candidates(signed, shared, floors, probes))
        best = materialise(_ranked(_scored(docs, pairs, shared, top), top))
        named = spark.createDataFrame([(k, None if q is None else int(q)) for k, q in enumerate(queries.ids)], "query int, item_id long")
        result = result.unionAll(best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    return result
