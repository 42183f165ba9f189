"""Disk that the steps of a join leave behind, and work that bounds must not leave out."""

import os
import random
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tidegauge.llm import decontaminate, hmm, ngram_join  # noqa: E402
from tidegauge.llm.text import sliced_words  # noqa: E402


def shuffle_files(spark) -> dict[str, int]:
    """Bytes by path of the shuffle files that the session holds."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in files if f.endswith(".data") and os.path.exists(f)}


def left_behind(spark, step) -> int:
    """Bytes of shuffle files that ``step`` leaves while the driver collects no garbage; files go a moment after their action."""
    before, kept = shuffle_files(spark), step()
    for _ in range(50):
        left = sum(n for f, n in shuffle_files(spark).items() if f not in before)
        if left < 60_000:
            break
        time.sleep(0.1)
    assert kept is not None
    return left


@pytest.fixture(scope="module")
def similar(spark, tmp_path_factory):
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(4000)}" for _ in range(200)) for _ in range(600)]
    rows = [*enumerate(texts), *((1000 + i, t + " end") for i, t in enumerate(texts[:200]))]
    folder = str(tmp_path_factory.mktemp("similar"))
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(folder)
    docs = spark.read.parquet(folder)
    ngram_join.jaccard_components(docs, sketch_bits=10, filter_bits=10)  # once classes are loaded, the driver collects its garbage rarely
    return docs


def test_the_join_keeps_no_shuffles_of_its_steps(spark, similar):
    assert left_behind(spark, lambda: ngram_join.jaccard_components(similar, sketch_bits=10, filter_bits=10)) < 60_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_near_duplicates_keep_no_shuffles_of_their_steps(spark, similar):
    assert left_behind(spark, lambda: corpus_pipeline.near_duplicates(spark, similar, "")) < 60_000


def test_training_takes_whole_texts_until_it_settles(spark, monkeypatch):
    draw, texts = random.Random(3), []
    for _ in range(40):
        side, words = 0, ["opening"]
        for _ in range(draw.randrange(200, 900)):
            side ^= draw.random() < 0.1
            words.append(f"{'ab'[side]}{draw.randrange(30)}")
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cls, begin, length = hmm.with_ends(next(sliced_words(pa.array(texts), lower=True, limit=1 << 24))[2])
    seen = np.bincount(cls, minlength=hmm.CLASSES) + 1.0
    got = hmm.train(docs, seen / seen.sum(), states=2, warm=1, sample=2)
    model = hmm.train(docs, seen / seen.sum(), states=2, warm=1, sample=2, rounds=0)
    monkeypatch.setattr(hmm, "SEGMENT", 1 << 30)
    before, rounds, settled = -np.inf, 0, False
    while not settled:
        counts = hmm.expected_counts(model, cls, begin, length)
        model, rounds = hmm.maximise(counts, 2, seen / seen.sum()), rounds + 1
        settled, before = counts[-1] - before < 1e-5 * abs(counts[-1]), counts[-1]
    assert rounds > 4 and length.max() > 512
    for x, y in ((got.start, model.start), (got.move, model.move), (got.emit, model.emit)):
        assert np.abs(x - y).max() < 1e-7
    assert abs(counts[:2].sum() - 40) < 1e-6


def test_segments_change_no_expected_count(monkeypatch):
    rng = np.random.default_rng(4)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(hmm.CLASSES), 3).T)
    n = np.array([1, 5, 3, 40, 700, 17])
    cls, begin = rng.integers(0, hmm.CLASSES, n.sum()).astype(np.int32), np.cumsum(n) - n
    counts = []
    for size in (1 << 30, 256, 16, 1):
        monkeypatch.setattr(hmm, "SEGMENT", size)
        counts.append(hmm.expected_counts(model, cls, begin, n))
    assert all(np.allclose(counts[0], c, rtol=1e-9, atol=1e-9) for c in counts)


def test_decontamination_finds_reworded_items_with_an_end_mark(spark):
    draw = random.Random(8)
    said = lambda n: [f"v{draw.randrange(50_000)}" for _ in range(n)]
    plain, marked, answer = said(30), said(24), said(6)
    items = [(3, " ".join(plain) + "."), (4, " ".join(marked) + ". " + " ".join(answer) + ".\n-----"), (5, "---")]
    reworded = [f"other{k}" if k % 2 else w for k, w in enumerate(marked)] + answer  # 18 of 30 words in order
    texts = [" ".join(said(50) + x + said(50)) for x in (plain, reworded, [])]
    docs = spark.createDataFrame([*enumerate(texts), (8, None), (9, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1, 4096):
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, block_items=block).collect()) == [2, 8, 9]
    assert {r.doc_id: r["items"] for r in decontaminate.find_contaminated(docs, bench).collect()} == {0: [3], 1: [4], 2: [], 8: [], 9: []}
