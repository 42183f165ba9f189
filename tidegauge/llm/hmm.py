"""Hidden Markov language model of words, trained by Baum-Welch over all partitions.

A word is emitted in two steps: a state emits one of ``2**BITS`` word classes (by hash) or the
end, and the class emits the word by its count, ``(c + 1) / (N_class + V_class + 1)``, with one
share for all words never seen. The probabilities of the model sum to 1. Its state tables have a fixed
size, so they travel to the tasks; word counts grow with the corpus and stay in a Spark table,
which meets the texts by a join.

Training: Spark counts all words of the training texts. Baum-Welch starts from the whole texts
of a bounded sample and then runs rounds over all training texts, until the log-likelihood gains
less than ``GAIN`` of itself, however many that takes: each task folds the expected counts of its
whole texts, and Spark adds them up. Texts are walked in segments of ``SEGMENT`` tokens side by
side; the products of their steps give the exact states at the borders, so no move is left out.
Scoring: scaled forward recursion over the whole text, exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.text import WIDE_BYTES, Words, map_batches, sliced_words
from tidegauge.llm.vectors import summed
from tidegauge.session import materialise, ship_package

BITS = 13
CLASSES = (1 << BITS) + 1  # the last one is the end
END = CLASSES - 1
SEGMENT = 256
GAIN = 1e-5
_U = np.uint64


def classes_of(names: np.ndarray) -> np.ndarray:
    return (names >> _U(64 - BITS)).astype(np.int32)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (CLASSES, states)

    def loglik(self, cls: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 of the likelihood of the sequences ``cls[begin : begin + length]``, all in step."""
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        out = np.zeros(len(order))
        if not len(order) or not length[0]:
            return out
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        alpha = None
        for t in range(int(length[0])):
            n = active[t]
            alpha = np.broadcast_to(self.start, (n, len(self.start))) if t == 0 else alpha[:n] @ self.move
            alpha = alpha * self.emit[cls[begin[:n] + t]]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            out[:n] += np.log10(scale)
        result = np.empty(len(order))
        result[order] = out
        return result


def _segments(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and number within its sequence of every segment."""
    pieces = -(-length // SEGMENT)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begin, pieces) + inner * SEGMENT
    return starts, np.minimum(SEGMENT, np.repeat(begin + length, pieces) - starts), inner


def _products(model: Hmm, cls: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The product of the steps of every segment, up to a factor; the first of a sequence begins without a move."""
    k, emit, turn = len(model.start), np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    out = np.empty((k, k, len(begin)))
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), 2048):
        now = order[lo : lo + 2048]
        at, n = begin[now], length[now]
        active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
        x = np.where(first[now], np.eye(k)[:, :, None], model.move[:, :, None]) * emit[:, cls[at]]
        for t in range(1, int(n[0])):
            m = active[t]
            if m < x.shape[2]:
                out[:, :, now[m : x.shape[2]]] = x[:, :, m:]
                x = x[:, :, :m]
            x = turn @ x
            x *= emit.take(cls[at[:m] + t], axis=1)
            if t % 16 == 0:
                x /= x.sum((0, 1))
        out[:, :, now[: x.shape[2]]] = x
    return np.moveaxis(out / out.sum((0, 1)), 2, 0)


def _borders(model: Hmm, cls: np.ndarray, begin: np.ndarray, length: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward state at the last token before every segment (0 before the first) and backward state at its last one, up to a factor."""
    k = len(model.start)
    before, after = np.zeros((len(begin), k)), np.ones((len(begin), k))
    goes_on = np.append(inner[1:] > 0, False)
    parts = np.flatnonzero(goes_on | (inner > 0))
    if len(parts):
        steps = _products(model, cls, begin[parts], length[parts], inner[parts] == 0)
        place = np.zeros(len(begin), dtype=np.int64)
        place[parts] = np.arange(len(parts))
        by_number = np.split(parts[np.argsort(inner[parts], kind="stable")], np.cumsum(np.bincount(inner[parts]))[:-1])
        for here in by_number:
            here = here[goes_on[here]]
            state = np.where(inner[here][:, None] == 0, model.start, before[here])
            state = (state[:, None, :] @ steps[place[here]])[:, 0]
            before[here + 1] = state / state.sum(1, keepdims=True)
        for here in by_number[:0:-1]:
            state = (steps[place[here]] @ after[here][:, :, None])[:, :, 0]
            after[here - 1] = state / state.sum(1, keepdims=True)
    return before, after


def expected_counts(model: Hmm, cls: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Expected starts, moves and emissions of the whole sequences and their log-likelihood, as one vector."""
    k, emit, turn = len(model.start), np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0
    begin, length, inner = _segments(begin, length)
    before, after = _borders(model, cls, begin, length, inner)
    enter = np.where(inner[:, None] == 0, model.start, before @ model.move)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), 2048):
        now = order[lo : lo + 2048]
        at, n = begin[now], length[now]
        steps = int(n[0])
        active = np.searchsorted(-n, -np.arange(steps), side="left")
        # a row per state and a column per segment, so that every operation runs along the segments
        alphas, scales, seen = [], [], []
        for t in range(steps):
            m = active[t]
            c = cls[at[:m] + t]
            alpha = (enter[now].T if t == 0 else turn @ alphas[-1][:, :m]) * emit.take(c, axis=1)
            scale = alpha.sum(0)
            alpha /= scale
            alphas.append(alpha)
            scales.append(scale)
            seen.append(c)
            total += np.log(scale).sum()
        beta = np.zeros((k, 0))
        gammas = [None] * steps
        for t in range(steps - 1, -1, -1):
            met = beta.shape[1]
            if t < steps - 1:
                ahead = emit.take(seen[t + 1], axis=1)
                ahead *= beta
                ahead /= scales[t + 1]
                moves += model.move * (alphas[t][:, :met] @ ahead.T)
                beta = model.move @ ahead
            if met < active[t]:
                last = after[now[met : active[t]]].T
                beta = np.concatenate([beta, last / (last * alphas[t][:, met:]).sum(0)], axis=1)
            gammas[t] = alphas[t] * beta
        moves += model.move * (before[now].T @ (emit[:, seen[0]] * beta / scales[0]).T)
        starts += gammas[0][:, inner[now] == 0].sum(1)
        flat, gamma = np.concatenate(seen), np.concatenate(gammas, axis=1)
        for j in range(k):
            emissions[:, j] += np.bincount(flat, weights=gamma[j], minlength=CLASSES)
    return np.concatenate([starts, moves.ravel(), emissions.ravel(), [total]])


def maximise(counts: np.ndarray, k: int, unigram: np.ndarray, prior: float = 20.0) -> Hmm:
    """The model of expected counts; emissions lean on the class frequencies by ``prior`` words."""
    starts, moves = counts[:k], counts[k : k + k * k].reshape(k, k)
    emissions = counts[k + k * k : k + k * k + CLASSES * k].reshape(CLASSES, k)
    emit = emissions + prior * unigram[:, None]
    return Hmm((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts with an end each, and each text's begin and length."""
    n = words.counts
    at = np.arange(len(words.name)) + words.text_of()
    cls = np.full(len(words.name) + len(n), END, dtype=np.int32)
    cls[at] = classes_of(words.name)
    return cls, words.bounds[:-1] + np.arange(len(n)), n + 1


def word_counts(texts: DataFrame) -> DataFrame:
    """``(name, c)`` of all words; tasks send each distinct word of a batch once."""

    def emit(batch: pa.RecordBatch):
        found = [w.name for _, _, w in sliced_words(batch.column("text"), lower=True, limit=WIDE_BYTES)]
        names, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        yield {"name": names, "c": counts}

    return map_batches(texts, emit, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, unigram: np.ndarray, states: int = 4, rounds: int | None = None, warm: int = 25, sample: int = 1000) -> Hmm:
    """Baum-Welch on all ``texts(doc_id, text)`` until it settles, or for ``rounds``; the start comes from ``sample`` whole texts by hash order."""
    length = states + states * states + CLASSES * states + 1

    def gather(model: Hmm):
        def fold(batches) -> np.ndarray:
            out = np.zeros(length)
            for batch in batches:
                for _, _, words in sliced_words(batch.column("text"), lower=True, limit=WIDE_BYTES):
                    cls, begin, n = with_ends(words)
                    out += expected_counts(model, cls, begin, n)
            return out

        return fold

    key = F.xxhash64("doc_id", "text")
    keys = texts.select(key.alias("key")).orderBy("key").limit(sample)
    wanted = np.unique(np.array([r.key for r in keys.collect()], dtype=np.int64))

    def whole(batch: pa.RecordBatch):
        there = batch.filter(pa.array(np.isin(batch.column("key").to_numpy(zero_copy_only=False), wanted)))
        for lo, hi, words in sliced_words(there.column("text"), lower=True, limit=WIDE_BYTES):
            cls, begin, n = with_ends(words)
            yield {"key": there.column("key").slice(lo, hi - lo), "x": pa.array([cls[b : b + m].astype(np.int16).tobytes() for b, m in zip(begin, n)], pa.binary())}

    # rows of one key have equal texts, so which of them stays makes no difference
    rows = map_batches(texts.select(key.alias("key"), "text"), whole, "key long, x binary").dropDuplicates(["key"]).orderBy("key")
    parts = [np.frombuffer(bytes(r.x), dtype=np.int16).astype(np.int32) for r in rows.toLocalIterator()]
    rng = np.random.default_rng(11)
    emit = unigram[:, None] * rng.gamma(1.0, 1.0, (CLASSES, states)) + 1e-12
    move = np.full((states, states), 0.02) + np.eye(states) * (1 - 0.02 * states)
    model = Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))
    if parts:
        n = np.array([len(p) for p in parts])
        cls = np.concatenate(parts)
        for _ in range(warm):
            model = maximise(expected_counts(model, cls, np.cumsum(n) - n, n), states, unigram)
    before = -np.inf
    for _ in count() if rounds is None else range(rounds):
        counts = summed(texts.select("text"), gather(model), length)
        model = maximise(counts, states, unigram)
        if counts[-1] - before < GAIN * abs(counts[-1]):
            break
        before = counts[-1]
    return model


def score_texts(docs: DataFrame, training: Column, states: int = 4, rounds: int | None = None, chunk_words: int = 4_000_000) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs(doc_id, text)``.

    Learns from the rows for which ``training`` (over ``doc_id``) holds. Null and empty texts
    are a single end. ``base_score`` is the add-one unigram score, ``score`` the model's
    log10 probability. Without training rows both are 0 for any text. Repeated rows are scored
    each; other columns are not looked at; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    ship_package(docs.sparkSession)
    texts = docs.where(training)
    n_texts = texts.count()
    counts = materialise(word_counts(texts.select("text")))
    per_class = counts.groupBy(F.shiftrightunsigned("name", 64 - BITS).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        tokens[r.k], types[r.k] = r.n, r.v
    tokens[END], types[END] = n_texts, min(n_texts, 1)
    total, distinct = int(tokens.sum()), int(types.sum())
    model = train(texts, (tokens + 1) / (tokens + 1).sum(), states, rounds) if total else None
    inside = np.log10(tokens + types + 1)
    inside[END] = 0.0  # the end is the only word of its class
    floor = np.log10(total + distinct + 1)
    ends = np.log10(n_texts + 1)

    chunks = max(1, round(total / chunk_words))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def ask(batch: pa.RecordBatch):
        chunk = batch.column("chunk").to_numpy()
        for k in np.unique(chunk):
            part = batch.filter(pa.array(chunk == k)).column("text")
            found = [w.name for _, _, w in sliced_words(part, lower=True, limit=WIDE_BYTES)]
            names = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
            yield {"chunk": np.full(len(names), k), "name": names}

    wanted = map_batches(dealt.select("chunk", "text"), ask, "chunk int, name long")
    answers = wanted.join(counts, "name").select("chunk", "name", "c")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names, place = np.unique(right.column("name").to_numpy().view(np.uint64), return_index=True)
        known = right.column("c").to_numpy()[place]
        out = {c: [] for c in ("n_tokens", "n_known", "base_score", "score")}
        column = left.column("text")
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        for _, _, words in sliced_words(column, lower=True, limit=WIDE_BYTES):
            at = np.searchsorted(names, words.name)
            at[at == len(names)] = 0
            hit = names[at] == words.name if len(names) else np.zeros(len(words.name), dtype=bool)
            c = np.where(hit, known[at], 0) if len(names) else np.zeros(len(words.name))
            of, n = words.text_of(), len(words.counts)
            logs = np.log10(c + 1.0)
            out["n_tokens"].append(words.counts + 1)
            out["n_known"].append(np.bincount(of, weights=hit, minlength=n).astype(np.int64) + (n_texts > 0))
            out["base_score"].append(np.bincount(of, weights=logs - floor, minlength=n) + (ends - floor))
            cls, begin, length = with_ends(words)
            plain = np.bincount(of, weights=logs - inside[classes_of(words.name)], minlength=n)
            out["score"].append(plain + model.loglik(cls, begin, length) if model else np.zeros(n))
        columns = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        return pa.table(
            {
                "doc_id": left.column("doc_id").cast(pa.int64()),
                "n_tokens": pa.array(columns["n_tokens"], pa.int64()),
                "n_known": pa.array(columns["n_known"].astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(left.num_rows, total), pa.int64()),
                "base_score": pa.array(columns["base_score"], pa.float64()),
                "score": pa.array(columns["score"], pa.float64()),
            }
        )

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
