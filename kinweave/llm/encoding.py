"""Encoding with a public byte-level BPE vocabulary through a sentencepiece model that is written, not trained."""

from __future__ import annotations

import base64
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.worker import kept

TOKENIZERS = "/opt/tokenizers"
CACHE = 300_000  # pre-tokens whose ids a worker keeps
ROWS = 256  # texts handled at once
# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same splits, faster: letters and digits come first, as they never begin with an apostrophe.
FAST = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII = FAST.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")


def byte_letters() -> list[str]:
    """A visible character for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def write_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: one byte-mapped piece per rank, scored by its negative rank; identity normaliser.

    Ranks must be 0..n-1. The unknown piece, which byte-mapped text never needs, has id n.
    """
    letters = byte_letters()
    pieces = sorted((rank, "".join(letters[b] for b in raw)) for raw, rank in ranks.items())
    if [r for r, _ in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = [_block(1, _block(1, p.encode()) + b"\x15" + struct.pack("<f", -r) + _number(3, 1)) for r, p in pieces]
    n = len(pieces)
    out.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, n + 1) + _number(40, n) + _number(41, -1) + _number(42, -1) + _number(43, -1) + _block(45, b"<unk>")
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _block(2, trainer) + _block(3, normalizer)


class Encoder:
    def __init__(self, model: bytes) -> None:
        import re

        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split, self.split_ascii = regex.compile(FAST).findall, re.compile(ASCII, re.A).findall
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def pre_tokens(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() else self.split(text)

    def mapped(self, token: str) -> str:
        if not token.isascii():
            token = token.encode("utf-8", "surrogatepass").decode("latin-1")
        return token.translate(self.table)

    def learn(self, fresh: list[str]) -> None:
        new = self.model.encode([self.mapped(t) for t in fresh], out_type=int, num_threads=1)
        n, m = len(self.known), len(new)
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=m)
        total = int(sizes.sum())
        while n + m > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(new), dtype=np.int32, count=total)
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.known.update(zip(fresh, range(n, n + m)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts in them; null and empty texts have none."""
        tokens = [self.pre_tokens(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.forget()
        known = self.known
        fresh = list(set().union(*tokens).difference(known))
        if fresh:
            self.learn(fresh)
        counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        total = int(counts.sum())
        if not total:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=total)
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[codes] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[at], bounds.astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        back = {c: b for b, c in enumerate(self.letters)}
        pieces = "".join(self.model.id_to_piece(int(i)) for i in ids)
        return bytes(back[c] for c in pieces).decode("utf-8", "surrogatepass")


def encode_texts(df: DataFrame, row_id: str, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """(row_id, ids ARRAY<INT>) of every row, without special tokens; null and empty texts give the empty list.

    Each text is split by the vocabulary's pattern; pre-tokens are mapped byte by byte to visible characters and
    encoded by a sentencepiece model written from the ranks. Nothing is shuffled; workers keep the ids of frequent
    pre-tokens. The model (1 MB for 50,000 pieces) travels with the task.
    """
    model = write_model(ranks)
    kind = df.schema[row_id].dataType

    def run(batches):
        encoder = kept(f"encoder_{len(model)}_{hash(model)}", lambda: Encoder(model))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                flat, bounds = encoder.encode(piece.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), ids], [row_id, "ids"])

    return df.select(row_id, text).mapInArrow(run, f"`{row_id}` {kind.simpleString()}, ids array<int>")
