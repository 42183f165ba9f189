"""Language of whole texts by nearest centroid.

A text is the TF-IDF vector of its letter bigrams and trigrams (bytes, lower case, other
characters as one blank), hashed to ``DIMS`` places and normalised. Inverse document
frequencies count all training documents. Each language gets ``centroids`` centroids by
spherical k-means on at most ``sample`` of its training documents, and a rejection distance
from the farthest of them. A text takes the language of the centroid with the highest cosine;
it is ``rejected`` when that cosine is below what the language's own documents reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.text import map_batches, slices, text_buffers
from tidegauge.llm.vectors import summed

DIMS = 1 << 12
UNKNOWN = "und"
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Counts of hashed bigrams and trigrams, one row per text."""
    n = len(offs) - 1
    code = _FOLD[data]
    if len(code) > 1:
        upper = (code[:-1] == 0xC3) & (code[1:] >= 0x80) & (code[1:] <= 0x9E)  # accented capitals of Latin-1
        code[1:][upper] += 0x20
    code = code.astype(np.uint32)
    of = np.repeat(np.arange(n), np.diff(offs))
    table = np.zeros(n * DIMS, dtype=np.int64)
    shift = np.uint32(32 - 12)
    gram = code.copy()
    for width in (2, 3):
        if len(code) < width:
            break
        gram = gram[:-1] * np.uint32(257) + code[width - 1 :]
        place = ((gram * np.uint32(2654435761)) >> shift).astype(np.int64)
        inside = (of[width - 1 :] == of[: len(of) - width + 1]) & (gram != (32 * 257 + 32 if width == 2 else (32 * 257 + 32) * 257 + 32))
        table += np.bincount((of[width - 1 :] * DIMS + place)[inside], minlength=n * DIMS)
    return table.reshape(n, DIMS)


def _tables(column: pa.Array, most: int = 256) -> Iterator[tuple[int, int, np.ndarray]]:
    offs, data = text_buffers(column)
    for lo, hi in slices(offs, most=most):
        part = offs[lo : hi + 1]
        yield lo, hi, gram_counts(part - part[0], data[part[0] : part[-1]])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether the cosine is too low for it."""
        cosines = vectors(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(1)
        top = cosines[np.arange(len(best)), best]
        return self.owner[best], top, top < self.least[self.owner[best]]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other."""
    picked = [x.sum(0)]
    picked[0] = picked[0] / max(np.linalg.norm(picked[0]), 1e-12)
    while len(picked) < min(k, len(x)):
        picked.append(x[(np.stack(picked) @ x.T).max(0).argmin()])
    c = np.stack(picked)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                mean = x[near == j].mean(0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def train_language(docs: DataFrame, train: object, centroids: int = 3, sample: int = 1500) -> LanguageModel | None:
    """Learn from ``docs(doc_id, text, lang)`` where the expression ``train`` holds and ``lang`` is not null.

    ``None`` when there is no such row with text.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(train)

    def frequencies(batches) -> np.ndarray:
        out = np.zeros(DIMS + 1)
        for batch in batches:
            for _, _, counts in _tables(batch.column("text")):
                out[:DIMS] += (counts > 0).sum(0)
                out[DIMS] += len(counts)
        return out

    sums = summed(rows.select("text"), frequencies, DIMS + 1)
    total = sums[DIMS]
    if not total:
        return None
    idf = np.log((1 + total) / (1 + sums[:DIMS])).astype(np.float32)
    keys = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    languages = sorted(r.lang for r in keys.select("lang").distinct().collect())
    held, owner, least = [], [], []
    for k, language in enumerate(languages):
        ids = [r.doc_id for r in keys.where(F.col("lang") == language).orderBy("h", "doc_id").limit(sample).select("doc_id").collect()]
        wanted = np.sort(np.array(ids, dtype=np.int64))

        def emit(batch: pa.RecordBatch):
            ids = batch.column("doc_id").cast(pa.int64())
            there = batch.filter(pa.array(np.isin(ids.to_numpy(zero_copy_only=False), wanted)))
            for _, _, counts in _tables(there.column("text")):
                yield {"x": pa.array([row.tobytes() for row in np.minimum(counts, 65535).astype(np.uint16)], pa.binary())}

        got = map_batches(rows.where((F.col("lang") == language) & F.col("doc_id").isNotNull()).select("doc_id", "text"), emit, "x binary").limit(2 * sample).collect()
        x = vectors(np.array([np.frombuffer(r.x, dtype=np.uint16) for r in sorted(got, key=lambda r: bytes(r.x))]), idf)
        c = _cluster(x, centroids)
        held.append(c)
        owner += [k] * len(c)
        least.append(float(np.quantile((x @ c.T).max(1), 0.01)) * 0.5)
    return LanguageModel(languages, idf, np.concatenate(held).astype(np.float32), np.array(owner), np.array(least))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row.

    A null text, one without a letter, and every text when there is no model, gets ``und``
    with score 0. Repeated rows repeat their prediction; other columns are not looked at.
    """

    def emit(batch: pa.RecordBatch):
        texts = batch.column("text")
        for lo, hi, counts in _tables(texts):
            languages = np.full(hi - lo, UNKNOWN, dtype=object)
            top, far = np.zeros(hi - lo), np.ones(hi - lo, dtype=bool)
            if model is not None:
                which, top, far = model.predict(counts)
                languages = np.array(model.languages, dtype=object)[which]
                for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                    if text is None or not (text[:64].isalpha() or any(map(str.isalpha, text))):
                        languages[i], top[i], far[i] = UNKNOWN, 0.0, True
            yield {
                "doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()),
                "lang_pred": pa.array(languages, pa.string()),
                "score": np.clip(top.astype(np.float64), 0, 1),
                "rejected": pa.array(far),
            }

    return map_batches(docs.select("doc_id", "text"), emit, "doc_id long, lang_pred string, score double, rejected boolean")
