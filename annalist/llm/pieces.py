"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A sequence of pieces is the merge encoding of a text exactly if every piece merges to itself and every two adjacent pieces, merged
again from their characters, come out as these two. So a text is cut from left to right: an Aho-Corasick automaton gives the longest piece
at each place; a piece that does not go with the one before it gives way to its longest shorter prefix; a place from
which no piece goes on is marked in a bitfield and never tried again, and the piece that led there is taken back. Each place is
left for good at most once, so the work is linear in the text.

Characters that no chain of pieces brings together never merge, and in most models no piece has a word mark after another character. Both are
read off the vocabulary, and texts are cut there first, so that short segments can be cached; what crosses no cut is exact. Characters outside the vocabulary become their UTF-8 bytes' pieces, or the unknown piece.

Defined results: null text is an empty text with no ids, decoded to an empty text; the mark U+2581 in a text is the same as a blank, so it
decodes to a blank; an empty table gives an empty table; only the named columns are read; ids of documents are read as long, a null one is
passed through; repeated rows give rows of their own; texts are taken whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import mapped, session_defaults

#: The character that stands for a blank.
MARK = "▁"
#: Entries of a worker's caches: of segments, twice (a full one is kept as the older, the one before it goes), and of pairs.
CACHE_ENTRIES, PAIR_ENTRIES = 200_000, 500_000
#: Longer segments are not cached.
CACHE_CHARS = 48


class Model:
    """A merge-type model: pieces with scores, byte pieces, and the encoder and decoder over them."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with identity normalisation that keeps all blanks is needed")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.raw: list[bytes | None] = []
        self.unknown, self.byte_ids = 0, [-1] * 256
        for k, p in enumerate(proto.pieces):
            raw: bytes | None = b""
            if p.type == kinds.NORMAL:
                self.id_of[p.piece], self.score[p.piece] = k, p.score
                raw = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = k
                raw = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown, raw = k, proto.trainer_spec.unk_surface.encode()
            elif p.type != kinds.CONTROL:
                raise ValueError("user-defined and unused pieces are not supported")
            self.raw.append(raw)
        self.fallback = proto.trainer_spec.byte_fallback and min(self.byte_ids) >= 0
        self.is_byte = np.zeros(len(self.raw), bool)
        self.is_byte[[b for b in self.byte_ids if b >= 0]] = True

        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        #: The longest proper prefix of two characters or more that is a piece. One character always stands for itself.
        self.shorter = {p: q for p in self.id_of if (q := next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.id_of), None))}
        self.segments = re.compile(self._segment_pattern(), re.DOTALL).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.goes: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def _segment_pattern(self) -> str:
        """Runs of characters that pieces bring together, with the blanks before them. No piece, so no merge, crosses their ends."""
        leader = {c: c for p in self.id_of for c in p}

        def find(c: str) -> str:
            while leader[c] != c:
                leader[c] = leader[leader[c]]
                c = leader[c]
            return c

        merging: set[str] = set()
        inside = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        for piece in self.id_of:
            body = piece if inside else piece.lstrip(MARK)
            for a, b in zip(body, body[1:]):
                leader[find(a)] = find(b)
                merging |= {a, b}
        groups: dict[str, list[str]] = {}
        for c in sorted(merging):
            groups.setdefault(find(c), []).append(c)
        together = sorted(groups.values(), key=len, reverse=True)
        runs = "".join(f"[{re.escape(''.join(g))}]+|" for g in together)
        return f"{runs}." if inside else f"{MARK}*(?:{runs}[^{MARK}])|{MARK}+"

    def merged(self, text: str) -> list[str]:
        """The encoding of a short string by merging: always the pair of highest score, the leftmost of equal ones."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reached(self, piece: str) -> bool:
        """Whether merging makes this piece at all."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(self.merged(piece)) == 1
        return known

    def adjacent(self, left: str, right: str) -> bool:
        """Whether the two, merged again from their characters, come out as they are."""
        if len(self.goes) >= PAIR_ENTRIES:
            self.goes.clear()
        known = self.goes[left, right] = self.merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a segment by backtracking."""
        n = len(text)
        longest = list(text)
        for end, piece in self.automaton.iter(text):
            # Ends ascend, so the last match noted at a place is the longest.
            longest[end - len(piece) + 1] = piece
        longest.append("")
        failed, some = bytearray((n >> 3) + 1), False
        goes, whole, shorter = self.goes.get, self.whole.get, self.shorter.get
        tokens: list[str] = []
        last, at, token = "", 0, longest[0]
        while at < n:
            end = at + len(token)
            if not (some and failed[end >> 3] >> (end & 7) & 1) and (whole(token) or self.reached(token)):
                fits = not last or goes((last, token))
                if fits is None:
                    fits = self.adjacent(last, token)
                if fits:
                    tokens.append(token)
                    last, at, token = token, end, longest[end]
                    continue
            if len(token) > 1:
                token = shorter(token) or token[0]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                some = True
                token = tokens.pop()
                at -= len(token)
                last = tokens[-1] if tokens else ""
        return tokens

    def ids(self, piece: str) -> list[int]:
        known = self.id_of.get(piece)
        if known is not None:
            return [known]
        return [self.byte_ids[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def segment(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            packed = struct.pack(f"<{len(ids)}i", *ids) if (ids := [k for piece in self.split(text) for k in self.ids(piece)]) else b""
        if len(text) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache, self.older = {}, self.cache
            self.cache[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        own = self.segment
        return b"".join([self.cache.get(s) or own(s) for s in self.segments(self.prefix + text.replace(" ", MARK))])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. The blank of the prefix goes; bytes that are no UTF-8 become U+FFFD each."""
        raw = self.raw
        try:
            out = b"".join([raw[i] for i in ids.tolist()]).decode()
        except UnicodeDecodeError:
            out = self._lenient(ids)
        return out[1:] if self.prefix and len(ids) and not self.is_byte[ids[0]] and out.startswith(" ") and ids[0] != self.unknown else out

    def _lenient(self, ids: np.ndarray) -> str:
        out, held = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                held += self.raw[i]
                continue
            while held:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[:size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                del held[:size]
            if i >= 0:
                out.append(self.raw[i].decode())
        return "".join(out)


@lru_cache(2)
def model(path: str) -> Model:
    """One model for each worker."""
    return Model(path)


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_tokens, ids (array of int)."""
    session_defaults(documents.sparkSession)

    def make(batch: pa.RecordBatch):
        m = model(path)
        packed = [m.encode(t or "") for t in batch.column(1).to_pylist()]
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids], ["id", "n_tokens", "ids"])

    return mapped(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Columns id, n_tokens, ids, text: the texts that the ids stand for."""
    session_defaults(encoded.sparkSession)

    def make(batch: pa.RecordBatch):
        m, lists = model(path), batch.column(2)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        texts = [m.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "text"])

    return mapped(encoded.select("id", "n_tokens", "ids"), make, "id long, n_tokens long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Columns id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""

    def make(batch: pa.RecordBatch):
        lists = batch.column(2)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        a = [hashlib.sha256(",".join(map(str, flat[s:e].tolist())).encode()).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        b = [hashlib.sha256(t).hexdigest() for t in batch.column(3).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(decoded.select("id", "n_tokens", "ids", "text"), make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
