"""Conversations as training text, with a loss mask on tokens.

A turn is ``<marker role>`` text ``<marker end>``. Markers are single tokens of their own that the encoder
cuts at before anything else, so tokens never reach over a turn's edge. Inside texts the
first character of every marker is doubled with a sign that no marker contains, which is
undone by ``unescape``: a text can hold the template's own strings and comes back unchanged.

Parts of a conversation are encoded once, with offsets; the sorted spans of the assistant's
texts meet the sorted token spans by binary search, and tokens inside them carry the loss.
A conversation is streamed in order of its turns: it is one part as long as it has at most
``part_chars`` characters and is cut between turns beyond, so that memory stays bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import ship_package

OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>"
ROLES = ("system", "user", "assistant", "tool", "other")
_SHIELD = "<|"
_TURN = re.compile(r"<\|turn:([^|]*)\|>(.*?)<\|end\|>", re.S)
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "conv_id long, part int, formatted string, n_turns int, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    """No marker can occur in the result."""
    return text.replace("<\\", "<\\\\").replace(_SHIELD, "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\([\\|])", lambda m: "<\\" if m[1] == "\\" else "<|", text)


def marker(role: str) -> str:
    """Roles outside the known ones keep their escaped name behind a common marker."""
    return f"{OPEN}{role}{CLOSE}" if role in ROLES[:-1] else f"{OPEN}other{CLOSE}{escape(role)}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns in a formatted part."""
    turns = []
    for role, text in _TURN.findall(formatted):
        if role == "other":
            role, _, text = text.partition("\n")
            role = unescape(role)
        turns.append((role, unescape(text)))
    return turns


@lru_cache(maxsize=2)
def _encoder(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = True  # their strings in texts are ordinary text
    encoder.post_processor = processors.ByteLevel(trim_offsets=False)
    encoder.add_tokens([AddedToken(f"{OPEN}{r}{CLOSE}", normalized=False) for r in ROLES] + [AddedToken(END, normalized=False)])
    return encoder


def loss_mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that lie inside one of the sorted, disjoint ``spans`` (rows of start and end)."""
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), dtype=bool)
    at = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return (at >= 0) & (ends <= spans[np.maximum(at, 0), 1]) & (ends > starts)


def format_conversations(turns: DataFrame, tokenizer: str = BYTE_BPE, part_chars: int = 1 << 18) -> DataFrame:
    """One row per part of a conversation, from ``turns(conv_id, turn, role, text)``.

    Columns: ``conv_id, part, formatted, n_turns, token_ids, token_starts, token_ends, loss``;
    offsets count code points of ``formatted``. Null texts are empty, a null role is the empty role;
    turns with equal numbers follow by role and text. A null ``conv_id`` is a conversation of
    its own. Other columns are ignored, an empty table gives an empty result.
    """
    ship_package(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        conv, part, pieces, spans, size, count, ready = None, 0, [], [], 0, 0, []

        def close():
            nonlocal pieces, spans, size, count, part
            if pieces:
                ready.append((conv[0], part, "".join(pieces), count, np.array(spans, dtype=np.int64).reshape(-1, 2)))
                part += 1
            pieces, spans, size, count = [], [], 0, 0

        def flush():
            coded = encoder.encode_batch([r[2] for r in ready], add_special_tokens=False)
            columns = {n: [] for n in names}
            for (conv_id, number, text, n, inside), code in zip(ready, coded):
                offsets = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
                values = (conv_id, number, text, n, code.ids, offsets[:, 0], offsets[:, 1], loss_mask(inside, offsets[:, 0], offsets[:, 1]))
                for name, value in zip(names, values):
                    columns[name].append(value)
            kinds = dict(zip(names, (pa.int64(), pa.int32(), pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))))
            ready.clear()
            return pa.RecordBatch.from_pydict({n: pa.array(columns[n], kinds[n]) for n in names})

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv is None or conv != (conv_id,):
                    close()
                    conv, part = (conv_id,), 0
                head, body = marker(role), escape(text)
                if size and size + len(head) + len(body) > part_chars:
                    close()
                if role == "assistant" and body:
                    spans.append((size + len(head), size + len(head) + len(body)))
                pieces += [head, body, END]
                size += len(head) + len(body) + len(END)
                count += 1
                if len(ready) >= 64 or sum(len(r[2]) for r in ready) > part_chars:
                    yield flush()
        close()
        if ready:
            yield flush()

    return ordered.mapInArrow(run, SCHEMA)


def _masked(formatted: str, starts, ends, loss) -> str:
    """The text under the mask; code points that several tokens share count once."""
    out, upto = [], 0
    for s, e, m in zip(starts, ends, loss):
        if m and e > upto:
            out.append(formatted[max(s, upto) : e])
            upto = e
    return "".join(out)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back: turns, their digest, and the text under the mask per conversation."""
    ship_package(formatted.sparkSession)
    ordered = formatted.select("conv_id", "part", "formatted", "token_starts", "token_ends", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, rows = None, None, []

        def close():
            if state is not None:
                rows.append((conv[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def table():
            columns = list(zip(*rows))
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "token_starts", "token_ends", "loss")]
            for conv_id, text, starts, ends, loss in zip(*columns):
                if conv is None or conv != (conv_id,):
                    close()
                    conv, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                learned = unescape(_masked(text, starts, ends, loss))
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(text)
            if len(rows) > 1000:
                yield table()
        close()
        if rows:
            yield table()

    return ordered.mapInArrow(run, schema)
