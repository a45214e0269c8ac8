"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Every byte is mapped to one letter, every token to the string of its bytes' letters, scored by its
negative rank, so that the model merges what the ranks merge first. The model normalises nothing.
Pre-tokens are encoded one by one and kept, since most of a text repeats: those used last in two generations, of
which the older one goes when the younger one is full, so that frequent ones are not encoded again. Ids stay in numpy arrays.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First of the 256 letters that stand for bytes.
LETTERS = 0x100
#: Pre-tokens in one generation.
KEPT = 100_000
#: Code points of texts that are encoded at once, and ids that are decoded at once.
CHARS_AT_ONCE = 1 << 20
IDS_AT_ONCE = 1 << 16
_BYTE_TO_LETTER = {b: chr(LETTERS + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def lettered(data: bytes) -> str:
    return data.decode("latin-1").translate(_BYTE_TO_LETTER)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _whole(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    """A piece: its string, its score and whether it is normal (1) or stands for the unknown (2)."""
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _whole(3, kind))


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model: piece 0 is the unknown, piece i + 1 the token of the i-th smallest rank.

    Its trainer part names the model type and the special pieces (only the unknown one), its normaliser
    part the identity, without an added, removed or escaped blank.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = [_piece("<unk>", 0.0, 2), *(_piece(lettered(t), -float(ranks[t]), 1) for t in tokens)]
    off = _varint((1 << 64) - 1)
    trainer = _whole(3, 2) + _whole(4, len(pieces)) + _whole(40, 0) + b"".join(_varint(f << 3) + off for f in (41, 42, 43))
    normaliser = _bytes(1, b"identity") + _whole(3, 0) + _whole(4, 0) + _whole(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encodes and decodes by a serialised model, the ranks in piece order, and a pre-token pattern."""

    def __init__(self, model: bytes, ranks: np.ndarray, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Blanks as Unicode has them: this library's own class also takes four separators of ASCII.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks = ranks.astype("<i4")
        letters = {chr(LETTERS + b): b for b in range(256)}
        pieces = (self.processor.id_to_piece(i + 1) for i in range(len(ranks)))
        self.bytes_of = {r: bytes(letters[c] for c in p) for r, p in zip(ranks.tolist(), pieces, strict=True)}
        self.whole = {token: rank for rank, token in self.bytes_of.items()}
        tokens = [self.bytes_of.get(r, b"") for r in range(int(ranks.max()) + 1)]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.decimals = np.array([f"{r} ".encode() for r in range(len(tokens))])
        # The ids of a pre-token, four bytes each.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        """Keeps the ids of pre-tokens: one that is a token itself is that token, others are encoded if the older ones lack them."""
        new = pre_tokens.difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.older, self.kept = self.kept, {}
            new = pre_tokens
        kept, older, rest, raw = self.kept, self.older, [], []
        for text in new:
            if (ids := older.get(text)) is not None:
                kept[text] = ids
                continue
            data = text.encode()
            if (rank := self.whole.get(data)) is not None:
                kept[text] = struct.pack("<i", rank)
            else:
                rest.append(text)
                raw.append(data)
        if not rest:
            return
        letters = lettered(b"".join(raw))
        ends = [0, *itertools.accumulate(map(len, raw))]
        found = self.processor.encode([letters[a:b] for a, b in itertools.pairwise(ends)], out_type=int, num_threads=1)
        packed = self.ranks[np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64) - 1].tobytes()
        ends = [0, *itertools.accumulate(4 * len(ids) for ids in found)]
        kept.update(zip(rest, (packed[a:b] for a, b in itertools.pairwise(ends)), strict=True))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; pre-tokens of all of them are encoded together."""
        parts = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*parts))
        for own in parts:
            yield np.frombuffer(b"".join(map(self.kept.__getitem__, own)), dtype="<i4")

    def encode(self, text: str) -> list[int]:
        return next(self.ids([text])).tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        out = []
        for low in range(0, len(ids), IDS_AT_ONCE):
            block = np.asarray(ids[low : low + IDS_AT_ONCE])
            many = self.length[block]
            moved = self.start[block] - (np.cumsum(many) - many)
            out.append(self.flat[np.repeat(moved, many) + np.arange(many.sum())].tobytes())
        return b"".join(out)

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by one space."""
        made = hashlib.sha256()
        for low in range(0, len(ids), IDS_AT_ONCE):
            written = self.decimals[ids[low : low + IDS_AT_ONCE]].view(np.uint8)
            written = written[written != 0]
            made.update(written[: len(written) - (low + IDS_AT_ONCE >= len(ids))].tobytes())
        return made.hexdigest()


@functools.lru_cache(maxsize=2)
def _codec(model: bytes, ranks: bytes, pattern: str) -> Codec:
    return Codec(model, np.frombuffer(ranks, dtype=np.int64), pattern)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in a row, of ``CHARS_AT_ONCE`` code points or one text each."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHARS_AT_ONCE:
            yield texts[low:i]
            low, held = i, 0
        held += len(text)
    yield texts[low:]


def coded(docs: DataFrame, text: Column, path: str, pattern: str, with_ids: bool = True) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256, and the ids if wanted) of a text column of ``docs``.

    The second digest is of the bytes decoded from the ids. Null texts are empty: no ids. Special tokens
    are ordinary text. The rank file is read once at the driver; its model, as large as the vocabulary,
    travels once to each executor. Texts are encoded whole, of any length; equal texts have equal results, row by row. A worker holds
    the ids of one text or of ``CHARS_AT_ONCE`` code points. An empty table gives no rows; no other column is looked at.
    """
    ranks = read_ranks(path)
    order = np.array(sorted(ranks.values()), dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((model_of(ranks), order.tobytes(), pattern))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(*sent.value)
        names = [part.split(" ")[0] for part in kind.split(", ")]
        for texts in batches:
            for group in _groups([t or "" for t in texts]):
                rows = []
                for ids in codec.ids(group):
                    row = len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids)).hexdigest()
                    rows.append((*row, ids) if with_ids else row)
                yield pd.DataFrame(rows, columns=names)

    return run(text)
