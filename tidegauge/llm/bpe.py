"""BPE encoding by a trie of distinct words, and decoding.

The distinct words of an Arrow batch go into a trie. A depth-first walk gives every node the
last token of the encoding of the path to it: it is the one token that ends there, is what its
own characters encode to, and stays apart from the last token where it begins. Encodings of
shared prefixes are thus found once, and a word's encoding is read back from the states on its
path. Encodings already found are kept per Python worker, up to ``KEEP`` words.

Two adjacent tokens stay apart when no merge across their border comes first: none that joins a
piece at the end of the left one to a piece at the start of the right one before either piece is
merged with its own side.

Vocabulary and merges come from a tokenizer file read on the driver; their size does not depend
on the data. Texts are encoded where they lie, without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.text import map_batches
from tidegauge.session import ship_package

KEEP = 200_000
LONG_WORD = 64
_NEVER = 1 << 60
#: Texts of these characters are lower-cased and split here; for others the tokenizers library does both.
_PLAIN = re.compile("[\x00-ȹ‐-‧€]*")
#: The split pattern of the vocabulary file, with its letters, numbers and white space spelt out for plain characters.
_L, _N, _GAP = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾", r"\x09-\x0D\x20\x85\xA0"
_SPLIT = re.compile(f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_GAP}{_L}{_N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


_LETTERS = byte_letters()
_TO_LETTERS = dict(enumerate(_LETTERS))
_TO_BYTES = {ord(c): b for b, c in enumerate(_LETTERS)}


@dataclass
class Vocabulary:
    """Tokens and merges of a byte-level BPE with word ends, as read from a tokenizer file."""

    ids: dict[str, int]
    special: dict[str, int]
    rank: dict[tuple[str, str], int]
    end: str
    source: str
    parts: dict[str, tuple[str, str]] = field(init=False)
    longest: int = field(init=False)
    tokens: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.parts = {a + b: (a, b) for a, b in self.rank}
        if len(self.parts) < len(self.rank):
            raise ValueError("a token with two merges has no unique encoding to walk by")
        self.longest = max(map(len, self.ids))
        named = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = [named.get(i, "") for i in range(max(named) + 1)]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as handle:
            source = handle.read()
        held = json.loads(source)
        model = held["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        return cls(model["vocab"], special, {m: k for k, m in enumerate(merges)}, model["end_of_word_suffix"] or "", source)


class PrefixEncoder:
    """Encodes words by a depth-first walk over the trie of their characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._edges: tuple[dict, dict] = ({}, {})
        #: Length of the longest token with the same last two characters.
        self._reach: dict[str, int] = {}
        for token in vocabulary.ids:
            bare = token.removesuffix(vocabulary.end)
            ending = bare[-2:] + token[len(bare) :]
            self._reach[ending] = max(self._reach.get(ending, 0), len(bare))
        self._apart: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._tokens = {token for token in vocabulary.ids if self.whole(token)}

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """Pieces that stand at the start (0) or end (1) of a token while it is merged, and when each goes."""
        held = self._edges[side].get(token)
        if held is None:
            held, piece, gone = [], token, _NEVER
            while True:
                held.append((piece, gone))
                parts = self.vocabulary.parts.get(piece)
                if parts is None:
                    break
                gone, piece = self.vocabulary.rank[parts], parts[side]
            self._edges[side][token] = held
        return held

    def _crosses(self, left: str, right: str, until: int) -> bool:
        """Whether a merge joins pieces of both before ``until``; of equal merges the left one comes first."""
        rank = self.vocabulary.rank
        for a, gone_a in self._edge(left, 1):
            for b, gone_b in self._edge(right, 0):
                r = rank.get((a, b), _NEVER)
                if r < until and r < gone_a and r <= gone_b:
                    return True
        return False

    def whole(self, token: str) -> bool:
        """Whether the characters of a token encode to the token itself."""
        held = self._whole.get(token)
        if held is None:
            parts = self.vocabulary.parts.get(token)
            held = token in self.vocabulary.ids
            if held and parts is not None:
                held = self.whole(parts[0]) and self.whole(parts[1]) and not self._crosses(*parts, self.vocabulary.rank[parts])
            self._whole[token] = held
        return held

    def apart(self, left: str, right: str) -> bool:
        if len(self._apart) > 4 * KEEP:
            self._apart.clear()
        held = self._apart[left, right] = not self._crosses(left, right, _NEVER)
        return held

    def _last(self, tail: str, depth: int, mark: str, last: list[str]) -> tuple[str, int]:
        """Last token of the path of ``depth`` characters that ends in ``tail``, and the depth where it begins."""
        n = len(tail)
        for size in range(min(self._reach.get(tail[-2:] + mark, 1), n), 0, -1):
            token = tail[n - size :] + mark
            if token in self._tokens:
                begin = depth - size
                if not begin:
                    return token, 0
                held = self._apart.get((last[begin], token))
                if held or (held is None and self.apart(last[begin], token)):
                    return token, begin
        raise ValueError(f"the vocabulary has no token for {tail[-1:] + mark!r}")

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of every word, given in the letters of the vocabulary; words are not empty."""
        root: dict = {}
        for word in words:
            node = root
            for c in word[:-1]:
                node = node.setdefault(c, {})
            node[word[-1], True] = word
        longest, mark, out = self.vocabulary.longest, self.vocabulary.end, {}
        last, began = [""], [0]
        # a node is visited after its parent and before its next sibling, so entries up to its parent stay right
        visits = [(0, "", root)]
        while visits:
            depth, tail, node = visits.pop()
            if depth:
                del last[depth:], began[depth:]
                token, begin = self._last(tail, depth, "", last)
                last.append(token)
                began.append(begin)
            for key, child in node.items():
                if isinstance(key, str):
                    visits.append((depth + 1, (tail + key)[-longest:], child))
                    continue
                token, at = self._last((tail + key[0])[-longest:], depth + 1, mark, last)
                tokens = [token]
                while at:
                    tokens.append(last[at])
                    at = began[at]
                out[child] = tokens[::-1]
        return out


class TextEncoder:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._walk = PrefixEncoder(vocabulary)
        self._known: dict[str, bytes] = {}
        self._library = None
        self._special = re.compile("|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def _words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.vocabulary.source)
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [word.translate(_TO_BYTES).encode("latin-1").decode() for word, _ in found]

    def _pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand between an empty string and themselves."""
        if self._special is None or not self._special.search(text):
            return self._words(text)
        out, at = [], 0
        for hit in self._special.finditer(text):
            out += [*self._words(text[at : hit.start()]), "\0" + hit.group()]
            at = hit.end()
        return out + self._words(text[at:])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        pieces = [self._pieces(text or "") for text in texts]
        if len(self._known) > KEEP:
            self._known = {}
        known = self._known
        fresh = set().union(*pieces).difference(known) if pieces else set()
        given = {}
        for word in fresh:
            if word[0] == "\0" and word[1:] in self.vocabulary.special:
                known[word] = np.array([self.vocabulary.special[word[1:]]], dtype="<u4").tobytes()
            else:
                given[word.encode().decode("latin-1").translate(_TO_LETTERS)] = word
        ids, beyond = self.vocabulary.ids, {}
        for letters, tokens in self._walk.encode(given).items():
            word = given[letters]
            (known if len(word) <= LONG_WORD else beyond)[word] = np.array([ids[t] for t in tokens], dtype="<u4").tobytes()
        if beyond:
            known = known | beyond
        return [b"".join(map(known.__getitem__, words)) for words in pieces]

    def decode(self, packed: bytes) -> str:
        """Text of ids: the tokens with a space between, since the file names no decoder."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_encoders: dict[int, TextEncoder] = {}


def _shared(docs: DataFrame, vocabulary: Vocabulary):
    """A function that returns the worker's encoder; the vocabulary is broadcast (a few MB, fixed)."""
    ship_package(docs.sparkSession)
    fields = (vocabulary.ids, vocabulary.special, vocabulary.rank, vocabulary.end, vocabulary.source)
    sent, number = docs.sparkSession.sparkContext.broadcast(fields), hash(vocabulary.source)

    def encoder() -> TextEncoder:
        if number not in _encoders:
            _encoders.clear()
            _encoders[number] = TextEncoder(Vocabulary(*sent.value))
        return _encoders[number]

    return encoder


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row of ``docs(doc_id, text)``, and the ``decoded`` ids if wanted.

    ``ids`` holds little-endian unsigned 32-bit integers. Null and empty texts have no tokens.
    Repeated rows are encoded each; other columns are not looked at; an empty table gives none.
    """
    encoder = _shared(docs, vocabulary)

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        coder = encoder()
        packed = coder.encode(batch.column("text").to_pylist())
        out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": [len(x) // 4 for x in packed], "ids": pa.array(packed, pa.binary())}
        yield out | ({"decoded": pa.array([coder.decode(x) for x in packed], pa.string())} if decoded else {})

    return map_batches(docs.select("doc_id", "text"), emit, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, text)`` for every row of ``encoded(doc_id, ids)``; null ids give an empty text."""
    encoder = _shared(encoded, vocabulary)

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        coder = encoder()
        yield {"doc_id": batch.column("doc_id").cast(pa.int64()), "text": [coder.decode(x or b"") for x in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), emit, "doc_id long, text string")
