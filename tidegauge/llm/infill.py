"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` code points with the code points
before each frame. A cut is found by binary search in those counts, and only the frame it falls
into is decompressed. The rearranged text is again a list of frames: whole frames are taken over
as they are, cut frames are replaced by the frames of their parts, and marks are small frames of
their own. Digests stream the frames of a text in order, one frame at a time.

Every row is transformed where it lies; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidegauge.llm.text import map_batches, record

FRAME = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
_LEVEL = 1
_FRAMED = "doc_id long, n long, marked boolean, frames array<binary>, before array<long>"
_MOVED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_MARK_FRAMES = {mark: zstandard.ZstdCompressor(level=_LEVEL).compress(mark.encode()) for mark in MARKS}


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("doc_id").cast(pa.int64())


def _frames(batch: pa.RecordBatch) -> Iterator[dict]:
    squeeze = zstandard.ZstdCompressor(level=_LEVEL).compress
    counts, marked, frames, before = [], [], [], []
    for text in batch.column("text").to_pylist():
        text = text or ""
        counts.append(len(text))
        marked.append(any(mark in text for mark in MARKS))
        frames.append([squeeze(text[k : k + FRAME].encode()) for k in range(0, len(text), FRAME)])
        before.append(list(range(0, len(text), FRAME)))
    yield {"doc_id": _ids(batch), "n": counts, "marked": marked, "frames": frames, "before": before}


def frame_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, marked, frames, before)`` for every row of ``docs(doc_id, text)``.

    ``n`` counts code points, ``before[i]`` those ahead of ``frames[i]``, and ``marked`` tells
    whether the text holds one of the marks. A null text is an empty one and has no frames.
    Repeated rows are framed each; other columns are not looked at; an empty table gives none.
    """
    return map_batches(docs.select("doc_id", "text"), _frames, _FRAMED)


def seek(frames: list[bytes], before: list[int], at: int) -> tuple[int, str, str]:
    """The frame that holds position ``at`` and its text up to and from there."""
    k = bisect.bisect_right(before, at) - 1
    text = zstandard.ZstdDecompressor().decompress(frames[k]).decode()
    return k, text[: at - before[k]], text[at - before[k] :]


def _span(frames: list[bytes], before: list[int], n: int, lo: int, hi: int) -> list[bytes]:
    """Frames of the code points ``lo`` up to ``hi``; only the frames at the two cuts are read."""
    if lo >= hi:
        return []
    squeeze = zstandard.ZstdCompressor(level=_LEVEL).compress
    first, _, tail = seek(frames, before, lo)
    ahead = before[first + 1] if first + 1 < len(frames) else n
    if hi <= ahead:
        return [frames[first]] if lo == before[first] and hi == ahead else [squeeze(tail[: hi - lo].encode())]
    out = [frames[first]] if lo == before[first] else [squeeze(tail.encode())]
    last, head, _ = seek(frames, before, hi) if hi < n else (len(frames), "", "")
    out += frames[first + 1 : last]
    return out + [squeeze(head.encode())] if head else out


def draws(doc_id: int | None) -> list[int]:
    """Four numbers from the digest of an id; a null id counts as an empty one."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _move(batch: pa.RecordBatch) -> Iterator[dict]:
    out = {name: [] for name in ("form", "prefix_chars", "middle_chars", "output")}
    rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "marked", "frames", "before")))
    for doc_id, n, marked, frames, before in rows:
        h1, h2, h3, h4 = draws(doc_id)
        if not n or marked or h3 % 100 >= 90:
            form, a, b, output = "plain", None, None, frames
        else:
            form = "spm" if h4 % 100 < 20 else "psm"
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            p, m, s = (_span(frames, before, n, lo, hi) for lo, hi in ((0, a), (a, b), (b, n)))
            p, s = [_MARK_FRAMES[PREFIX], *p], [_MARK_FRAMES[SUFFIX], *s]
            output = [*p, *s, _MARK_FRAMES[MIDDLE], *m] if form == "psm" else [*s, *p, _MARK_FRAMES[MIDDLE], *m]
            b -= a
        for name, value in zip(out, (form, a, b, output)):
            out[name].append(value)
    yield {"doc_id": batch.column("doc_id"), "n": batch.column("n"), **out}


def fill_in_middle(framed: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``frame_texts``.

    Cuts and form follow the digest of ``doc_id`` alone, so repeated ids with equal texts give
    equal results. ``output`` lists the frames of the new text. Empty texts, texts that hold a
    mark and a tenth of the rest stay as they are (``plain``, with null counts).
    """
    return map_batches(framed, _move, _MOVED)


def stream(frames: list[bytes]) -> Iterator[bytes]:
    """The bytes of a framed text, a frame at a time."""
    reader = zstandard.ZstdDecompressor()
    for frame in frames:
        yield reader.decompress(frame)


def restore(output: list[bytes], form: str) -> Iterator[bytes]:
    """The original text of an output, in pieces, found from its marks alone."""
    if form == "plain":
        yield from stream(output)
        return
    # the text is free of marks, so the first place of each one is where it was put
    text = b"".join(stream(output))
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, two, three = text.index(first.encode()), text.index(second.encode()), text.index(MIDDLE.encode())
    parts = {first: text[one + len(first) : two], second: text[two + len(second) : three]}
    yield parts[PREFIX]
    yield text[three + len(MIDDLE) :]
    yield parts[SUFFIX]


def _digest(batch: pa.RecordBatch) -> Iterator[dict]:
    output_sha, restored_sha = [], []
    for form, output in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist()):
        for sums, pieces in ((output_sha, stream(output)), (restored_sha, restore(output, form))):
            digest = hashlib.sha256()
            for piece in pieces:
                digest.update(piece)
            sums.append(digest.hexdigest())
    keep = {name: batch.column(name) for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars")}
    yield keep | {"output_sha256": output_sha, "restored_sha256": restored_sha}


def output_digests(moved: DataFrame) -> DataFrame:
    """Digests of the output and of the text restored from it, for every row of ``fill_in_middle``."""
    return map_batches(moved, _digest, _DIGESTS)


def _then(first: Callable, schema: str, second: Callable) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    between = to_arrow_schema(_parse_datatype_string(schema))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for columns in first(batch):
            yield from second(record(columns, between))

    return run


def infill_digests(docs: DataFrame) -> DataFrame:
    """``output_digests(fill_in_middle(frame_texts(docs)))`` in one pass over the rows."""
    return map_batches(docs.select("doc_id", "text"), _then(_then(_frames, _FRAMED, _move), _MOVED, _digest), _DIGESTS)
