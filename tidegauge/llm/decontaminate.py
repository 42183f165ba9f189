"""Documents that contain benchmark items, exactly or reworded: counting of rare words, then order.

1. All documents are read once for the frequencies of the benchmark's words (letters and digits,
   A-Z lower-cased).
2. *Counting.* A region that has ``loose`` of an item's words in order holds all but the rest of
   any choice of its words. Every item watches its rarest words, as many as may go missing and a
   share ``spare`` of its length more; a region with fewer than those spare ones cannot pass. So
   no item, however many or long they are, is lost before verification, and frequencies only
   decide how much is verified.
3. *Verification.* Regions begin an item's length before a passage of ``STEP`` words that holds a
   watched word and end one after the ``SPAN`` words from it. The longest common subsequence of
   an item and the region decides: ``exact`` of the item's words, or ``loose`` of them and
   ``answer`` of its answer, which is its last sentence.

Benchmarks of any size work in blocks of ``block_items`` items, a scan each, so that what a
task holds is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.text import Words, map_batches, sliced_words, text_buffers, words_of
from tidegauge.llm.vectors import summed
from tidegauge.session import ship_package

STEP, SPAN = 16, 64
_U = np.uint64
_BITS = 20


@dataclass
class Items:
    ids: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    member: np.ndarray  # a bit per hash prefix, to pass over most other words quickly
    fan: np.ndarray | None = None  # where the items of each column begin in ``watching``
    watching: np.ndarray | None = None
    need: np.ndarray | None = None  # watched words that a region must hold, by item

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word indices that hold a benchmark word, and its column."""
        maybe = np.flatnonzero(self.member[(words.name >> _U(64 - _BITS)).view(np.int64)])
        at = np.searchsorted(self.vocabulary, words.name[maybe])
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == words.name[maybe]
        return maybe[hit], at[hit]


def _names(texts: list[str]) -> list[np.ndarray]:
    words = words_of(*text_buffers(pa.array(texts, pa.string())), lower=True, plain=True)
    return [words.name[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:])]


def answer_of(text: str) -> str:
    """The last sentence or line that has words; a rule of dashes or an end mark below it is no answer."""
    parts = [p for p in re.split(r"(?<=[.!?:])\s+|\n+", text.strip()) if re.search(r"[0-9A-Za-z]|[^\x00-\x7F]", p)]
    return parts[-1] if parts else ""


def _members(vocabulary: np.ndarray) -> np.ndarray:
    member = np.zeros(1 << _BITS, dtype=bool)
    member[(vocabulary >> _U(64 - _BITS)).view(np.int64)] = True
    return member


def prepare_items(rows: list[tuple[int, str]]) -> Items:
    rows = sorted((i, t) for i, t in rows if i is not None and t)
    words = _names([t for _, t in rows])
    held = [k for k, w in enumerate(words) if len(w)]
    answers = _names([answer_of(rows[k][1]) for k in held])
    vocabulary = np.unique(np.concatenate([words[k] for k in held])) if held else np.zeros(0, dtype=np.uint64)
    return Items(np.array([rows[k][0] for k in held], dtype=np.int64), [words[k] for k in held], answers, vocabulary, _members(vocabulary))


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine-word row at a time."""
    masks: dict[int, int] = {}
    for k, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        match = masks.get(word)
        if match:
            met = row & match
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def watched(docs: DataFrame, items: Items, loose: float, spare: float) -> Items:
    """``items`` with the words each of them watches, the rarest in ``docs``, as the vocabulary."""
    size = len(items.vocabulary)

    def count(batches) -> np.ndarray:
        out = np.zeros(size)
        for batch in batches:
            for _, _, words in sliced_words(batch.column("text"), lower=True, plain=True):
                out += np.bincount(items.places(words)[1], minlength=size)
        return out

    seen = summed(docs.select("text"), count, size)
    columns, owners, need = [], [], []
    for i, words in enumerate(items.words):
        distinct, copies = np.unique(np.searchsorted(items.vocabulary, words), return_counts=True)
        order = np.argsort(seen[distinct], kind="stable")
        missing = len(words) - math.ceil(loose * len(words) - 1e-9)
        held = np.cumsum(copies[order])
        last = np.searchsorted(held, min(len(words), missing + max(1, math.ceil(spare * len(words)))))
        columns.append(distinct[order[: last + 1]])
        owners.append(np.full(last + 1, i))
        need.append(held[last] - missing)
    column, owner = np.concatenate(columns), np.concatenate(owners)
    order = np.argsort(column, kind="stable")
    used, first = np.unique(column[order], return_index=True)
    vocabulary = items.vocabulary[used]
    return Items(items.ids, items.words, items.answers, vocabulary, _members(vocabulary), np.append(first, len(order)), owner[order], np.array(need))


def _search(words: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, region's first word, end, item)`` where a region holds enough of an item's watched words."""
    at, column = items.places(words)
    times = items.fan[column + 1] - items.fan[column]
    ends = np.cumsum(times)
    item = items.watching[np.arange(times.sum()) + np.repeat(items.fan[column] - (ends - times), times)]
    stride = len(words.name) + 1
    key = np.sort(item * stride + np.repeat(at, times))
    item, at = np.divmod(key, stride)
    text = np.searchsorted(words.bounds, at, side="right") - 1
    start = words.bounds[text] + (at - words.bounds[text]) // STEP * STEP
    new = np.ones(len(key), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    item, text, start = item[new], text[new], start[new]
    size = np.array([len(w) for w in items.words], dtype=np.int64)[item]
    lo = np.maximum(words.bounds[text], start - size - STEP)
    hi = np.minimum(words.bounds[text + 1], start + SPAN + size + STEP)
    enough = np.searchsorted(key, item * stride + hi) - np.searchsorted(key, item * stride + lo) >= items.need[item]
    return text[enough], lo[enough], hi[enough], item[enough]


def _verdicts(batch: pa.RecordBatch, items: Items, rule) -> Iterator[tuple[int, int, list[list[int]], np.ndarray]]:
    exact, loose, answer = rule
    for lo, hi, words in sliced_words(batch.column("text"), lower=True, plain=True):
        found: list[dict[int, float]] = [{} for _ in range(hi - lo)]
        best = np.zeros(hi - lo)
        for t, a, b, i in zip(*(x.tolist() for x in _search(words, items))):
            if i in found[t]:
                continue
            item, said = items.words[i], items.answers[i]
            region = words.name[a:b]
            common = lcs(item, region) / len(item)
            best[t] = max(best[t], common)
            if common >= exact or (common >= loose and len(said) and lcs(said, region) >= answer * len(said)):
                found[t][i] = common
        yield lo, hi, [sorted(items.ids[list(f)].tolist()) for f in found], best


def _blocks(docs: DataFrame, benchmark: DataFrame, block_items: int, rule: tuple[float, float, float], spare: float):
    held = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = -(-max(held.count(), 1) // block_items)
    for k in range(blocks):
        part = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        items = prepare_items([(r.item_id, r.text) for r in part.collect()])
        if len(items.ids):
            yield watched(docs, items, min(rule[:2]), spare)


def find_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    exact: float = 0.75,
    loose: float = 0.6,
    answer: float = 0.8,
    spare: float = 0.3,
    block_items: int = 4096,
) -> DataFrame:
    """``(doc_id, contaminated, items, best_lcs)`` for every row of ``docs(doc_id, text)``.

    ``items`` lists the ids of the benchmark items found, ``best_lcs`` is the largest share of
    an item's words in order among the candidates (0 without one). Null and empty texts are clean.
    Items without id, text or words are ignored; repeated items are found each. Repeated rows
    repeat their verdict. Other columns are not looked at; empty tables give no findings.
    """
    rule = (exact, loose, answer)
    columns = "doc_id long, contaminated boolean, items array<long>, best_lcs double"
    judged = docs.select(F.col("doc_id").cast("long"), "text", F.lit(False).alias("contaminated"), F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("best_lcs"))
    for items in _blocks(docs, benchmark, block_items, rule, spare):

        def emit(batch: pa.RecordBatch, items=items):
            before = [batch.column(c).to_pylist() for c in ("items", "best_lcs")]
            for lo, hi, found, best in _verdicts(batch, items, rule):
                every = [sorted(a + b) for a, b in zip(before[0][lo:hi], found)]
                yield {
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                    "text": batch.column("text").slice(lo, hi - lo),
                    "contaminated": pa.array([bool(f) for f in every]),
                    "items": pa.array(every, pa.list_(pa.int64())),
                    "best_lcs": np.maximum(best, before[1][lo:hi]),
                }

        # a block of items after the other adds to the verdict of each row
        judged = map_batches(judged, emit, columns.replace("contaminated", "text string, contaminated"))
    return judged.drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, exact: float = 0.75, loose: float = 0.6, answer: float = 0.8, spare: float = 0.3, block_items: int = 4096) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find_contaminated`` finds nothing."""
    ship_package(docs.sparkSession)
    rule = (exact, loose, answer)
    out = docs
    for items in _blocks(docs, benchmark, block_items, rule, spare):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for lo, hi, found, _ in _verdicts(batch, items, rule):
                    clean[lo:hi] = [not f for f in found]
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
