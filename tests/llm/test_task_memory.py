"""Memory that the arrays of one Python worker take beside its batch of texts."""

import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tidegauge.llm import ngram_join, quality, text  # noqa: E402


@pytest.fixture(scope="module")
def column():
    """4 MB of texts, as one Arrow batch of a session has them, some null or empty and one longer than a slice."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(1700)]
    return pa.array([None, "", *texts, " ".join(draw.choices(words, k=100_000))], pa.string())


def peak(step) -> float:
    """MB of arrays at most while ``step`` runs, the tables that a worker keeps included."""
    text._powers.clear()
    tracemalloc.start()
    try:
        for _ in step():
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_needs_little_beside_its_batch(column):
    short = column.slice(0, len(column) - 1)
    assert short.nbytes > 3_000_000
    assert peak(lambda: ngram_join.shingle_sets(short, 5)) < 48
    assert peak(lambda: quality._rows(short)) < 64


def test_sets_do_not_depend_on_the_slices(column, monkeypatch):
    def sets(limit):
        cut = lambda column, lower=False, plain=False: text.sliced_words(column, lower, limit, plain)
        monkeypatch.setattr(ngram_join, "sliced_words", cut)
        return [names[a:b] for _, _, names, bounds in ngram_join.shingle_sets(column, 5) for a, b in zip(bounds[:-1], bounds[1:])]

    whole, cut = sets(1 << 24), sets(text.SLICE_BYTES)
    assert len(whole) == len(cut) == len(column) and len(whole[0]) == len(whole[1]) == 0
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and len(whole[-1]) > 90_000
