"""Quality scores learned from positives and unlabelled text (non-negative PU risk).

A logistic model ``g`` minimises ``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])``
with the logistic loss ``l``: trusted positives ``P``, unlabelled documents ``U`` and an
estimated class prior. When the second part falls below zero the step undoes it, so that the
model cannot profit from fitting the positives that ``U`` contains.

Features describe whole texts: frequencies of neighbouring byte classes, and how words and
lines repeat. The features of every document are computed and scored where it lies; only the
bounded sample of ``sample`` documents of either kind, taken by hash order, meets the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.text import int_column, map_batches, slices, text_buffers, words_of
from tidegauge.session import ship_package

_CLASS = np.full(256, 9, dtype=np.int64)  # other punctuation and control bytes
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4
for _k, _byte in enumerate(b".,!|", 5):
    _CLASS[_byte] = _k
_CLASS[0x80:0xA0], _CLASS[0xA0:0xC0], _CLASS[0xC0:] = 10, 11, 12
KINDS = 13
FEATURES = KINDS * KINDS + 8


def features(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; a text without bytes has zeros only."""
    n = len(offs) - 1
    length = np.diff(offs)
    of_byte = np.repeat(np.arange(n), length)
    kind = _CLASS[data]
    same = of_byte[1:] == of_byte[:-1]
    pair = (of_byte[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:])[same]
    table = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1) / np.maximum(length, 1)[:, None]
    words = words_of(offs, data)
    count = words.counts
    per = np.maximum(count, 1)
    of_word = words.text_of()
    sums = lambda x, of: np.bincount(of, weights=x, minlength=n)
    size = (words.end - words.start).astype(float)
    again = (words.name[1:] == words.name[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((words.name, of_word))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (words.name[order][1:] != words.name[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = sums(fresh.astype(float), of_word[order])
    mean = sums(size, of_word) / per
    spread = np.sqrt(np.maximum(sums(size * size, of_word) / per - mean * mean, 0))
    extra = np.stack(
        [
            np.log1p(count), mean / 10, spread / 10, sums(again.astype(float), of_word[1:]) / per, distinct / per,
            np.log1p(distinct) / np.log1p(per), np.log1p(length) / 10, (count == 0).astype(float),
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(table), extra], axis=1)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-60, 60)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 1e-4) -> QualityModel:
    """Full-batch Adam on the non-negative risk; deterministic."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0, dtype=np.float64), both.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-6, scale, np.inf)
    p, u = (((x - mean) / scale).clip(-8, 8) for x in (positive, unlabelled))
    w, bias = np.zeros(both.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z.clip(-60, 60)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w + bias), sigmoid(u @ w + bias)
        negative_risk = np.logaddexp(0, u @ w + bias).mean() - prior * np.logaddexp(0, p @ w + bias).mean()
        d_pos, d_neg_p, d_neg_u = prior * (sp - 1) / len(p), -prior * sp / len(p), su / len(u)
        if negative_risk < 0:
            grad = -np.append(p.T @ d_neg_p + u.T @ d_neg_u, d_neg_p.sum() + d_neg_u.sum())
        else:
            grad = np.append(p.T @ (d_pos + d_neg_p) + u.T @ d_neg_u, (d_pos + d_neg_p).sum() + d_neg_u.sum())
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * min(1.0, 2 - 2 * t / steps)
        w, bias = w - step[:-1], bias - step[-1]
    return QualityModel(mean, scale, w, float(bias), prior)


def _rows(column: pa.Array):
    offs, data = text_buffers(column)
    for lo, hi in slices(offs, most=4096):
        part = offs[lo : hi + 1]
        yield lo, hi, features(part - part[0], data[part[0] : part[-1]])


def train_quality(docs: DataFrame, labels: DataFrame, train: object, sample: int = 6_000) -> QualityModel | None:
    """Fit on documents for which the column expression ``train`` (over ``doc_id``) holds.

    Label 1 of ``labels(doc_id, quality)`` marks positives; documents without a label are the
    unlabelled ones. The prior is the share of label 1 among the labelled rows in the fold.
    At most ``sample`` documents of either kind are used. Without a positive or an unlabelled
    document there is no model (``None``).
    """
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).where(train)
    marks = labels.where(F.col("quality").isNotNull()).where(train).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    stats = marks.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    known = ids.distinct().join(marks, "doc_id", "left")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = {
        kind: np.sort(np.array([r.doc_id for r in known.where(rule).orderBy(*order).limit(sample).select("doc_id").collect()], dtype=np.int64))
        for kind, rule in (("p", F.col("quality") == 1), ("u", F.col("quality").isNull()))
    }
    if not len(chosen["p"]) or not len(chosen["u"]):
        return None
    wanted = np.union1d(chosen["p"], chosen["u"])

    def emit(batch: pa.RecordBatch):
        there = batch.filter(pa.array(np.isin(int_column(batch, "doc_id"), wanted)))
        for lo, hi, x in _rows(there.column("text")):
            yield {"doc_id": there.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), "x": pa.array([row.astype(np.float32).tobytes() for row in x], pa.binary())}

    # of the texts of a repeated id the one with the smallest features counts
    found = map_batches(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), emit, "doc_id long, x binary")
    got = found.groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r.doc_id)
    held, x = np.array([r.doc_id for r in got]), np.array([np.frombuffer(r.x, dtype=np.float32) for r in got])
    return fit_nnpu(x[np.isin(held, chosen["p"])], x[np.isin(held, chosen["u"])], min(float(stats), 0.999))


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``(doc_id, score)`` for every row; null and empty texts are scored as texts without bytes.

    Scores lie in 0 to 1. Without a model every score is 0.5. Repeated rows repeat their score.
    """

    def emit(batch: pa.RecordBatch):
        for lo, hi, x in _rows(batch.column("text")):
            yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), "score": model.scores(x) if model else np.full(hi - lo, 0.5)}

    return map_batches(docs.select("doc_id", "text"), emit, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel | None, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more; all rows without a model."""
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            texts, keep = batch.column("text"), np.zeros(batch.num_rows, dtype=bool)
            for lo, hi, x in _rows(texts):
                keep[lo:hi] = model.scores(x) >= least
            yield batch.filter(pa.array(keep))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
