"""Words of whole texts as arrays, for use inside Spark tasks.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; since UTF-8 never uses
those bytes inside a character, bytes and characters agree. Word names are 64-bit hashes of
the whole word, computed for a slice of texts at a time from running sums, so the cost is a
few array passes over the bytes. Null texts count as empty.

Names are content hashes: equal words have equal names on every executor, without a shared
dictionary. Two different words of a corpus with ``V`` distinct words share a name with
probability about ``V * V / 2**65``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidegauge.session import ship_package

#: Arrays take 20 to 50 bytes per byte of a slice, tables of powers 16 more, and a worker keeps most of it for its
#: next task. An executor holds up to two workers per core when a task has two Python steps in a row.
SLICE_BYTES = 1 << 19
#: For recursions whose every step runs over all texts of a slice.
WIDE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_NOT_ALNUM = np.ones(256, dtype=bool)
_NOT_ALNUM[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _NOT_ALNUM[_lo:_hi] = False
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = next((k + 1 for k in (SLICE_BYTES, WIDE_BYTES) if n <= k + 1), n)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if n <= WIDE_BYTES + 1:
            _powers[base] = table
    return table[:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n, lo = len(column), column.offset
    if offsets is None or n == 0:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[lo : lo + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


@dataclass
class Words:
    """Words of consecutive texts: ``bounds[i]:bounds[i + 1]`` are those of text ``i``."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """Index of the text of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def word_spans(offs: np.ndarray, data: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word index at which each text begins.

    ``plain`` words consist of ASCII letters and digits and of all other characters beyond ASCII.
    """
    solid = ~(_NOT_ALNUM if plain else _GAP)[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def words_of(offs: np.ndarray, data: np.ndarray, lower: bool = False, plain: bool = False) -> Words:
    start, end, bounds = word_spans(offs, data, plain)
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power_table(_BASE, n), out=sums[1:])
    name = (sums[end] - sums[start]) * _power_table(pow(_BASE, -1, 1 << 64), n + 1)[start]
    return Words(mix64(name + (end - start).astype(np.uint64)), start, end, bounds, data)


def slices(offs: np.ndarray, limit: int = SLICE_BYTES, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of up to ``most`` texts of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1), lo + most, n)
        yield lo, hi
        lo = hi


def sliced_words(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES, plain: bool = False) -> Iterator[tuple[int, int, Words]]:
    """``(lo, hi, words)`` for consecutive ranges of the texts of a column."""
    offs, data = text_buffers(column)
    for lo, hi in slices(offs, limit):
        part = offs[lo : hi + 1]
        yield lo, hi, words_of(part - part[0], data[part[0] : part[-1]], lower, plain)


def combine(names: np.ndarray, width: int) -> np.ndarray:
    """Name of the ``width`` consecutive names from each position on (``n - width + 1`` of them)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = names[:n].copy()
    for k in range(1, width):
        out *= _U(0xD6E8FEB86659FD93)
        out += names[k : k + n]
    return mix64(out + _U(width))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``function`` to every Arrow batch; it yields dicts of column arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield record(columns, target)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def record(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        values = columns[field.name]
        if isinstance(values, np.ndarray) and values.dtype == np.uint64:
            values = values.view(np.int64)
        arrays.append(values if isinstance(values, pa.Array) and values.type == field.type else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows ``values[bounds[i]:bounds[i + 1]]`` as a list column."""
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def int_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A non-null integer column as an int64 array."""
    return batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed."""
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, count: int, kind) -> np.ndarray:
    """The array of ``count`` values that ``pack`` was given."""
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(bytes(data), decompressed_size=size, codec="zstd", asbytes=True), dtype=kind)


def crc_fold(column: str, modulus: int):
    """``crc32`` of a value's text, modulo ``modulus``: the fold of a row."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def _bit_places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = mix64(ids.astype(np.int64).view(np.uint64)) >> _U(64 - bits)
    return (at >> _U(3)).view(np.int64), (_U(1) << (at & _U(7))).astype(np.uint8)


def hash_bits(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit map of ``2**bits`` bits with the hash places of a one-column table of integers set."""
    ship_package(ids.sparkSession)
    column, size = ids.columns[0], (1 << bits) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            np.bitwise_or.at(seen, *_bit_places(int_column(batch, column), bits))
        yield pa.RecordBatch.from_pydict({"data": pa.array([pack(seen)], pa.binary())})

    out = np.zeros(size, dtype=np.uint8)
    for row in ids.coalesce(32).mapInArrow(mark, "data binary").toLocalIterator():
        out |= unpack(row.data, size, np.uint8)
    return out


def marked_values(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which integers have their bit set."""
    at, bit = _bit_places(values, int(len(bits) * 8).bit_length() - 1)
    return bits[at] & bit != 0


def where_marked(df: DataFrame, column: str, bits: np.ndarray, marked: bool) -> DataFrame:
    """The rows whose value has its bit set (or not set); a null has none."""
    shared, width = df.sparkSession.sparkContext.broadcast(bits), int(len(bits) * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            at, bit = _bit_places(pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), width)
            hit = (shared.value[at] & bit != 0) & values.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit == marked))

    ship_package(df.sparkSession)
    return df.mapInArrow(run, df.schema)
