"""Sums of fixed-size vectors over all partitions of a table.

Each task folds its rows into one vector and sends it in compressed pieces. The pieces of
an equal position are added up by Spark in two levels, so that no task adds up more than a
``FAN``-th of the partial vectors of its piece; the driver receives the final vector only,
whose size is fixed by the caller and does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidegauge.llm.text import pack, unpack
from tidegauge.session import ship_package

FAN = 64
_SCHEMA = "piece int, part int, data binary"


def summed(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, kind=np.float64, piece: int = 1 << 18) -> np.ndarray:
    """Sum over partitions of ``fold(batches)``, an array of ``length`` values of ``kind``."""
    ship_package(df.sparkSession)
    cuts = list(range(0, length, piece)) + [length]

    def rows(numbers, part, vectors) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"piece": pa.array(numbers, pa.int32()), "part": pa.array([part] * len(numbers), pa.int32()), "data": pa.array([pack(x) for x in vectors], pa.binary())}
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.ascontiguousarray(fold(batches), dtype=kind)
        yield rows(range(len(cuts) - 1), TaskContext.get().partitionId() % FAN, [total[a:b] for a, b in zip(cuts[:-1], cuts[1:])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, total = None, 0, None
        for batch in batches:
            for k, p, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "data"))):
                values = unpack(data, cuts[k + 1] - cuts[k], kind)
                total = values.copy() if total is None else total + values
                number, part = k, p
        yield rows([number], part, [total])

    out = np.zeros(length, dtype=kind)
    pieces = df.mapInArrow(partial, _SCHEMA).groupBy("piece", "part").applyInArrow(add, _SCHEMA)
    for row in pieces.groupBy("piece").applyInArrow(add, _SCHEMA).toLocalIterator():
        out[cuts[row.piece] : cuts[row.piece + 1]] += unpack(row.data, cuts[row.piece + 1] - cuts[row.piece], kind)
    return out
