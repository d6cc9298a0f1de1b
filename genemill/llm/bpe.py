"""Byte-level BPE as a sentencepiece model that is written straight from a rank file.

A rank file (base64 token, rank) becomes a sentencepiece BPE model: every token is a piece whose bytes are mapped
to printable characters, its score is the negative rank, normalisation is the identity. A text is cut by the
pattern of the vocabulary, each part is encoded by itself, and ids are decoded by the inverse mapping.

Null and empty texts give no ids. Texts of any length are whole; equal texts give equal ids. Other columns pass
through untouched, since the operators are column functions. There is no shuffle: the model (under 2 MB for 50k
tokens, checked against `MAX_BROADCAST_BYTES`) goes to every task, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.llm.common import MAX_BROADCAST_BYTES, add_by_slices, as_bytes, as_texts

CACHED_PARTS, CACHED_LENGTH = 200_000, 48  # of the memory of one task; longer parts are encoded each time


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: pieces (1), trainer settings (2), normaliser settings (3)."""
    chars = byte_characters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(map(chars.__getitem__, token)).encode()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    unknown = _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)
    out.append(_field(1, unknown))
    # model kind BPE, size, no byte fallback, the unknown piece is the last one
    out.append(_field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(35, 0) + _field(40, len(tokens))))
    # identity, no space put before, none removed, none replaced
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes in one task; parts of the text that come again are kept."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None):
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(tokens))
        self.chars = {i: c for i, c in enumerate(byte_characters())}
        # a part that is itself a token is that token, whatever its merges give
        self.known = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.cache: dict[str, bytes] = {}

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        raw = [p.encode() for p in parts]
        out = {p: self.known[r] for p, r in zip(parts, raw) if r in self.known}
        rest = [(p, r.decode("latin-1").translate(self.chars)) for p, r in zip(parts, raw) if p not in out]
        if rest:
            ids = self.model.encode([m for _, m in rest], num_threads=1)
            out |= {p: np.array(i, "<u4").tobytes() for (p, _), i in zip(rest, ids)}
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, cache = self.find(text), self.cache
        new = set(parts).difference(cache)
        if new:
            if len(cache) + len(new) > CACHED_PARTS:
                cache.clear()
                new = set(parts)
            found = self._encode_parts(list(new))
            if len(new) > CACHED_PARTS or any(len(p) > CACHED_LENGTH for p in new):
                cache.update((p, i) for p, i in found.items() if len(p) <= CACHED_LENGTH and len(cache) < CACHED_PARTS)
                return b"".join([found[p] if p in found else cache[p] for p in parts])
            cache.update(found)
        return b"".join(map(cache.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shared(spark: SparkSession, vocabulary: str, pattern: str):
    """A function that gives a task its codec."""
    tokens = read_ranks(vocabulary)
    model = model_bytes(tokens)
    if len(model) > MAX_BROADCAST_BYTES:
        raise ValueError(f"a vocabulary of {len(model)} bytes is too large to send to every task")
    shared = spark.sparkContext.broadcast((tokens, pattern, model))
    made: list[Codec] = []

    def get() -> Codec:
        if not made:
            made.append(Codec(*shared.value))
        return made[0]

    return get


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of a text column (binary, four bytes an id)."""
    get = _shared(docs.sparkSession, vocabulary, pattern)

    def encode(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([get().encode(t) for t in as_texts(texts)], pa.binary())]

    return add_by_slices(docs, [text], [T.StructField(out, T.BinaryType())], encode)


def decode_documents(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for."""
    get = _shared(df.sparkSession, vocabulary, pattern)

    def decode(values: pa.Array) -> list[pa.Array]:
        return [pa.array([get().decode(i) for i in as_bytes(values)], pa.binary())]

    return add_by_slices(df, [ids], [T.StructField(out, T.BinaryType())], decode)


def n_ids(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded bytes of every text, in one pass."""
    get = _shared(docs.sparkSession, vocabulary, pattern)

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = [get().encode(t) for t in as_texts(texts)]
        return [pa.array(ids, pa.binary()), pa.array([get().decode(i) for i in ids], pa.binary())]

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return add_by_slices(docs.select("doc_id", "text"), ["text"], fields, both).select("doc_id", "ids", "decoded")
