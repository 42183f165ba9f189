"""Removal of long passages that an earlier document already has, by recompression.

A window is ``window`` consecutive words. A word goes when a window covering it also starts in
a document with a smaller id; windows are judged on the input.

1. *Recompression.* Every document becomes a shorter sequence in ``ROUNDS`` rounds. A run of
   more than ``RUN`` equal words becomes one symbol; then, in each round, symbols toss a
   coin that depends on their name and the round only, and each neighbouring pair of a head
   and a tail becomes one symbol. Names are content hashes and so globally the same: equal
   passages get equal symbols but for ``MARGIN`` words at either end, wherever they stand (a
   round can change one more symbol there, and a run cut by the end up to ``RUN`` words).
2. *Sharing.* Spark counts the documents of every symbol of 3 to ``LONGEST`` words. A window
   can be a repeat only if no symbol strictly inside it, a margin from its ends, belongs to a
   single document. Symbols of other lengths, and those beside a long run, never rule a
   window out, so nothing is lost; the latter are counted all the same, since the run can be
   shorter in another document, where the symbol does rule out.
3. *Verification.* The windows left are named in full and looked up: the smallest document
   that has the name decides.

Every step moves rows in proportion to the words; a passage that a third of the documents
share costs a row per occurrence, and sorted rows stream by, so that no group is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.text import Words, combine, hash_bits, int_column, map_batches, marked_values, mix64, sliced_words, where_marked
from tidegauge.session import materialise, ship_package

ROUNDS, RUN = 3, 4
LONGEST = 2**ROUNDS
MARGIN = LONGEST - 1 + RUN
_U = np.uint64


def recompress(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(name, start, size, counted, ruling)`` of the final symbols; starts count words from the first text.

    ``counted`` symbols have 3 to ``LONGEST`` words; ``ruling`` ones are also away from long runs.
    """
    name, n = words.name.copy(), len(words.name)
    of_text = words.text_of()
    # long runs of one word become one symbol
    change = np.ones(n, dtype=bool)
    change[1:] = (name[1:] != name[:-1]) | (of_text[1:] != of_text[:-1])
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, n))
    long = size > RUN
    runs = np.stack([start[long], start[long] + size[long]]) if long.any() else np.zeros((2, 0), dtype=np.int64)
    keep = np.ones(n, dtype=bool)
    if long.any():
        inside = np.zeros(n + 1, dtype=np.int64)
        np.add.at(inside, runs[0] + 1, 1)
        np.add.at(inside, runs[1], -1)
        keep = np.cumsum(inside[:-1]) == 0
        name[runs[0]] = mix64(name[runs[0]] * _U(0xA0761D6478BD642F) + size[long].astype(np.uint64))
    start = np.flatnonzero(keep)
    name, text = name[start], of_text[start]
    for turn in range(1, ROUNDS + 1):
        if len(name) < 2:
            break
        head = (mix64(name ^ _U(turn * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> _U(63)) == 0
        joined = np.zeros(len(name), dtype=bool)
        joined[1:] = head[:-1] & ~head[1:] & (text[1:] == text[:-1])
        left = np.flatnonzero(joined) - 1
        name[left] = mix64(name[left] * _U(0xE7037ED1A0B428DB) + name[left + 1] + _U(turn))
        name, start, text = name[~joined], start[~joined], text[~joined]
    ends = words.bounds[1:][text]
    size = np.minimum(np.append(start[1:], n), ends) - start
    counted = (size >= 3) & (size <= LONGEST)
    ruling = counted.copy()
    if runs.shape[1]:
        before = np.searchsorted(runs[0], start, side="right") - 1
        near = (before >= 0) & (start - runs[1][np.maximum(before, 0)] < MARGIN)
        after = np.searchsorted(runs[0], start, side="left")
        near |= (after < runs.shape[1]) & (runs[0][np.minimum(after, runs.shape[1] - 1)] - (start + size) < MARGIN)
        ruling &= ~near
    return name, start, size, counted, ruling


def _repeated_ids(docs: DataFrame, bits: int = 20) -> np.ndarray:
    """A bit map of the ids that stand on rows with different texts."""
    texts = docs.groupBy("doc_id").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    return hash_bits(texts.where("a <> b").select("doc_id"), bits)


def _row_keys(batch: pa.RecordBatch, repeated: np.ndarray) -> np.ndarray:
    """0 for a row whose id names one text, else the hash of its text: with the id it names the row's text."""
    return np.where(marked_values(int_column(batch, "doc_id"), repeated), int_column(batch, "row"), 0)


def _of_row(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to the table of places by id, and by text where the id has several."""
    there = places.withColumnsRenamed({"doc_id": "_of_id", "row": "_of_text"})
    same = (F.col("doc_id") == F.col("_of_id")) & ((F.col("_of_text") == 0) | (F.col("_of_text") == F.xxhash64("text")))
    return docs.join(there, same, how).drop("_of_id", "_of_text")


def _symbols(docs: DataFrame, window: int, repeated) -> DataFrame:
    def emit(batch: pa.RecordBatch):
        ids, keys = int_column(batch, "doc_id"), _row_keys(batch, repeated.value)
        for lo, _, words in sliced_words(batch.column("text")):
            name, start, size, counted, ruling = recompress(words)
            of = np.searchsorted(words.bounds, start, side="right") - 1
            counted &= words.counts[of] >= window
            ruling &= counted
            # documents with a window that no symbol can rule out share one name of their own
            free = _free_starts(words, start[ruling], size[ruling], window)
            free = np.unique(np.searchsorted(words.bounds, free, side="right") - 1)
            of, start = of[counted], start[counted]
            of_row = lo + np.append(of, free)
            yield {
                "name": np.append(name[counted], np.zeros(len(free), dtype=np.uint64)),
                "doc_id": ids[of_row],
                "row": keys[of_row],
                "pos": np.append(start - words.bounds[of], np.full(len(free), -1)),
            }

    return map_batches(docs, emit, "name long, doc_id long, row long, pos int")


def _free_starts(words: Words, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """Word indices at which a window begins that has none of the given symbols inside its margins."""
    n = len(words.name)
    begun, ended = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    begun[start + 1] = 1  # symbols that begin before a word
    ended[start + size] = 1  # symbols that end up to a word
    begun, ended = np.cumsum(begun), np.cumsum(ended)
    text = words.text_of()
    at = np.arange(max(0, n - window + 1))
    at = at[text[at] == text[at + window - 1]]
    return at[ended[at + window - MARGIN] <= begun[at + MARGIN]]


def _starts(words: Words, shared: np.ndarray, window: int) -> np.ndarray:
    """Word indices at which a window begins that no unshared symbol rules out."""
    _, start, size, _, ruling = recompress(words)
    lone = ruling & ~np.isin(start, shared)
    return _free_starts(words, start[lone], size[lone], window)


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """``(doc_id, row, pos)``: windows that also start in a document with a smaller id.

    ``row`` is 0 but for ids on rows with different texts, where it is the hash of the text.
    """
    if window < 2 * MARGIN + 2 * LONGEST - 1:
        raise ValueError(f"windows need {2 * MARGIN + 2 * LONGEST - 1} words at least")
    docs = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row")).where("doc_id is not null")
    repeated = docs.sparkSession.sparkContext.broadcast(_repeated_ids(docs))
    symbols = _symbols(docs, window, repeated).repartition("name").sortWithinPartitions("name", "doc_id")
    shared = symbols.mapInArrow(_of_several, "doc_id long, row long, pos int").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("shared"))

    def emit(batch: pa.RecordBatch):
        ids, keys = int_column(batch, "doc_id"), _row_keys(batch, repeated.value)
        lists = batch.column("shared")
        flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        for lo, hi, words in sliced_words(batch.column("text")):
            rows = np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1]))
            at = _starts(words, flat[cuts[lo] : cuts[hi]] + words.bounds[rows], window)
            of = np.searchsorted(words.bounds, at, side="right") - 1
            yield {"name": combine(words.name, window)[at], "doc_id": ids[lo + of], "row": keys[lo + of], "pos": at - words.bounds[of]}

    windows = map_batches(_of_row(docs, shared, "inner"), emit, "name long, doc_id long, row long, pos int")
    ordered = windows.repartition("name").sortWithinPartitions("name", "doc_id")
    return ordered.mapInArrow(_after_first, "doc_id long, row long, pos int")


def _runs(batch: pa.RecordBatch, before: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns of a sorted batch, after ``before``, and where the runs of equal names begin."""
    columns = [batch.column(c).to_numpy() for c in ("name", "doc_id", "row", "pos")]
    if before is not None:
        columns = [np.concatenate(pair) for pair in zip(before, columns)]
    name = columns[0]
    return (*columns, np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, dtype=np.int64))


def _places(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "row": pa.array(row, pa.int64()), "pos": pa.array(pos, pa.int32())})


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose name occurs in several documents, from rows sorted by name and document."""
    held, open_name = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        name, doc, row, pos, starts = _runs(batch, held)
        size = np.diff(np.append(starts, len(name)))
        several = np.logical_or.reduceat(doc != np.repeat(doc[starts], size), starts)
        several[0] |= name[0] == open_name
        keep = np.repeat(several, size)
        # the last run may go on; until a second document comes, its rows wait
        last = starts[-1]
        held, open_name = (None, name[-1]) if several[-1] else ([x[last:] for x in (name, doc, row, pos)], None)
        yield _places(doc[keep], row[keep], pos[keep])


def _after_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a name after those of its first document, from rows sorted by name and document."""
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        name, doc, row, pos, starts = _runs(batch)
        first = doc[starts]
        if carried is not None and carried[0] == name[0]:
            first[0] = carried[1]
        carried = (name[-1], first[-1])
        later = doc != np.repeat(first, np.diff(np.append(starts, len(name))))
        yield _places(doc[later], row[later], pos[later])


def _with_gone(docs: DataFrame, window: int, filter_bits: int = 24) -> DataFrame:
    """``docs`` and the starts of their repeated windows as ``_gone``.

    A bit map of fixed size tells which documents may have any; only those are shuffled.
    """
    gone = materialise(repeated_windows(docs, window).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("_gone")))
    bits = hash_bits(gone.select("doc_id"), filter_bits)
    marked = _of_row(where_marked(docs, "doc_id", bits, True), gone, "left").select(*docs.columns, "_gone")
    return marked.unionAll(where_marked(docs, "doc_id", bits, False).withColumn("_gone", F.lit(None).cast("array<int>")))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row; ``kept`` joins the words left by one space.

    Null and empty texts have no words. Rows with a null ``doc_id`` are returned whole. Rows that
    repeat a ``doc_id`` never take words from each other; each loses the windows of its own text
    that start in a row with a smaller id. Other columns are not looked at; an empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", "text")
    return _cut(_with_gone(docs, window), window, "kept")


def _kept_texts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    lists = batch.column("_gone")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
    for lo, hi, words in sliced_words(batch.column("text")):
        n = len(words.name)
        rows = np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1]))
        begin = flat[cuts[lo] : cuts[hi]] + words.bounds[rows]
        cover = np.zeros(n + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, np.minimum(begin + window, n), -1)
        keep = np.cumsum(cover[:-1]) == 0
        texts = []
        raw = words.data.tobytes()
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            at = np.flatnonzero(keep[a:b]) + a
            texts.append(b" ".join([raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]))
        removed = words.counts - np.add.reduceat(np.append(keep, False), words.bounds[:-1]) * (words.counts > 0)
        yield lo, hi, words.counts, removed, texts


def _cut(joined: DataFrame, window: int, result: str) -> DataFrame:
    def emit(batch: pa.RecordBatch):
        for lo, hi, counts, removed, texts in _kept_texts(batch, window):
            last = pa.array(texts, pa.binary()).cast(pa.string()) if result == "kept" else pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), "n_words": counts, "n_removed": removed, result: last}

    return map_batches(joined, emit, f"doc_id long, n_words long, n_removed long, {result} string")


def removal_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """As ``remove_repeats``, with ``kept_sha256`` in place of the kept text."""
    docs = docs.select("doc_id", "text")
    return _cut(_with_gone(docs, window), window, "kept_sha256")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with all columns, ``text`` cut where words were removed and ``n_chars`` to match.

    Texts from which nothing goes stay as they are, whitespace included.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, _, _, removed, kept in _kept_texts(batch, window):
                for i in np.flatnonzero(removed):
                    texts[lo + i] = kept[i].decode()
            columns = {c: batch.column(c) for c in schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                sizes = [n if t is None else len(t) for t, n in zip(texts, columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    ship_package(docs.sparkSession)
    return _with_gone(docs, window).mapInArrow(run, schema)
