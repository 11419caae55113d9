"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

A rank file lists byte strings in merge order. `model_proto` serialises a sentencepiece BPE model from it:
each byte string becomes a piece of printable characters (one per byte), its score is the negative rank, the
normaliser is the identity. Merging the pair of highest score is then the merge of lowest rank, so each
pre-token gets the ids of the original encoder. A pre-token that is a piece itself is its one id.
Decoding is the inverse mapping: ids to byte strings.

Defined results: null text is an empty text with no ids; an empty table gives an empty table; only the named columns
are read; document ids are read as long, a null id is passed through; repeated rows give rows of their own; ids of a text depend on that text alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import mapped, session_defaults

#: Entries of a worker's pre-token cache. Emptied when full, so its memory is bounded.
CACHE_ENTRIES = 200_000
#: Longer pre-tokens are not cached.
CACHE_BYTES = 48


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 bytes are themselves, the rest follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protocol-buffer field: an int as varint, a float as fixed32, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order with score -rank, an unknown piece after them."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    chars, out = byte_characters(), []
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(chars[b] for b in raw).encode()) + _field(2, float(-rank))))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, float(-len(ranks))) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts by a rank file and a pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        with open(ranks_path, "rb") as f:
            self.ranks = read_ranks(f.read())
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.find = regex.compile(pattern).findall
        self.by_id = [raw for raw, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        chars = byte_characters()
        self.map = {b: chars[b] for b in range(256)}
        self.cache: dict[str, bytes] = {}

    def pre_token(self, word: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.map))
        packed = np.asarray(ids, "<u4").tobytes()
        if len(raw) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        get, own = self.cache.get, self.pre_token
        return b"".join([get(w) or own(w) for w in self.find(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        by_id = self.by_id
        return b"".join([by_id[i] for i in ids.tolist()])


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker."""
    return Codec(ranks_path, pattern)


def encode(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_tokens, ids (array of int)."""
    session_defaults(documents.sparkSession)

    def make(batch: pa.RecordBatch):
        c = codec(ranks_path, pattern)
        packed = [c.encode(t or "") for t in batch.column(1).to_pylist()]
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids], ["id", "n_tokens", "ids"])

    return mapped(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, n_tokens long, ids array<int>")


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Decode the ids: columns id, n_tokens, ids_sha256, decoded_sha256."""
    session_defaults(encoded.sparkSession)

    def make(batch: pa.RecordBatch):
        c = codec(ranks_path, pattern)
        lists = batch.column(2)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        a, b = [], []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            ids = flat[s:e]
            a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(encoded.select("id", "n_tokens", "ids"), make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
