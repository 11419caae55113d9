"""Benchmark decontamination by CGK embeddings, bit-sampling LSH over item-sized windows and exact edit verification.

Texts are normalised first: lower case, punctuation becomes space, one space between words. All lengths are in characters.

Embedding: a walk reads the character at its place, writes it down and moves on or stays, as a random bit of (step, character)
says. Two windows with few edits between them are read alike again soon after each edit, so edit distance becomes Hamming
distance of what the walks wrote. Windows of an item's size are seen from every word of them (every character of scripts without
spaces, and beyond RUN characters without a space): from each such start, in each repetition, a key of steps drawn at
random is read from the embedding, by the item's size as DRAWS says. A shared key of a document's start p and an item's start o makes the
item-sized window at p - o a candidate. An item takes WALKS repetitions, and as many more as it needs for KEYS keys in all if it has few
starts (long words), up to MOST_WALKS, which reaches the recall that the README gives as measured with MAX_EDITS of the characters edited.

Items under SHORT characters have too few starts. They are looked up exactly: their walk always moves on and is written whole. An
item of n characters with up to k = MAX_EDITS * n edits has n // q pieces of q = n // (k + 1) characters, of which n // q - k or more
are intact in any copy, on diagonals (place in the document less place in the item) that differ by k at most.

Candidates of either kind are cut by an exact filter, the four-character sequences that window and item share (a copy keeps n - 3 - 4 k
of them), and then verified by exact edit distance of the whole item against the document around the window.

Defined results: null and empty texts and items match nothing; items of any length and script are looked for, those too short for
an edit (under 7 characters) as whole words, where a change of script ends a word too; ties of distance give the first place; rows that repeat an id or an item give rows of their own; empty tables give empty tables;
ids are read as long; only the named columns are read. The benchmark is read in blocks of bounded size, one after the other, so that what the driver and each worker hold is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import U64, chunks, mapped, mix, seeded, session_defaults, written

#: Edits that an item may have, as a share of its length.
MAX_EDITS = 0.15
#: Least size of an item, steps of its walks, steps of them that make a key: short items have few starts, so that their keys are to hit more often.
DRAWS = ((40, 24, 8), (80, 36, 12))
#: Least and most repetitions of an item, keys that it is to have, characters without a space after which every character is a start.
WALKS, MOST_WALKS, KEYS, RUN = 4, 32, 48, 16
STEPS = max(steps for _, steps, _ in DRAWS)
#: Items under so many characters are looked up exactly.
SHORT = DRAWS[0][0]
#: Bytes of text that are looked through at once, and starts whose walks go on together.
PIECE_BYTES, PIECE_STARTS = 1 << 21, 1 << 15
#: Benchmark rows, and characters of them, that one pass holds.
BLOCK_ROWS, BLOCK_CHARS = 20_000, 8 << 20
#: Short items whose hits are sorted together; entries of a window table that are held at once; bits of a filter and of a sequence's number.
PART_ITEMS, WINDOW_CELLS, FILTER_BITS, KIND_BITS = 256, 4 << 20, 21, 14
#: Characters are told apart in the walks as so many kinds; verification compares the characters themselves.
SYMBOLS = 1024

_ODD = U64(0x9E3779B97F4A7C15)
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: General and ideographic punctuation.
_WIDE = re.compile("[\u00a0\u2000-\u206f\u3000-\u303f]+")


def normalised(text: str) -> str:
    low = text.lower()
    if not low.isascii():
        low = _WIDE.sub(" ", low)
    return b" ".join(low.encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("utf-8", "surrogatepass")


def symbols(text: str) -> np.ndarray:
    """A small number for each character; 0 is for padding alone."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(point < SYMBOLS // 2, point, SYMBOLS // 2 + (point * 0x9E3779B1 >> 7) % (SYMBOLS // 2))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The `size` symbols (6 at most) from each place as one number, up to the last place that has so many."""
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out << U64(10) | data[k : k + n].astype(U64)
    return out


def kinds(data: np.ndarray) -> np.ndarray:
    """A small number for the four symbols from each place."""
    return ((grams(data, 4) * _ODD) >> U64(64 - KIND_BITS)).astype(np.int32)


def slots(key: np.ndarray) -> np.ndarray:
    return (key * _ODD >> U64(64 - FILTER_BITS)).astype(np.int64)


class Table:
    """Keys with the items and places that have them."""

    def __init__(self, key: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.own, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[slots(self.own)] = True

    def hits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into key, item, offset) of each equal pair."""
        at = np.flatnonzero(self.seen[slots(key)])
        which = np.minimum(np.searchsorted(self.own, key[at]), len(self.own) - 1)
        same = self.own[which] == key[at]
        at, which = at[same], which[same]
        count = self.first[which + 1] - self.first[which]
        row = np.repeat(self.first[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(at, count), self.item[row], self.offset[row]


class Walks:
    """The repetitions of one draw: random bits of (step, symbol), the steps that are sampled and the words that make a key of them."""

    def __init__(self, steps: int, samples: int, count: int) -> None:
        bits = seeded(count * steps * SYMBOLS, 0xC6C + steps).reshape(count, steps, SYMBOLS)
        self.moves = (bits >> U64(63)).astype(np.int64)
        self.words = mix(bits)
        draw = seeded(count * steps, 0xB17 + steps).reshape(count, steps)
        self.sampled = [set(np.argsort(row)[:samples].tolist()) for row in draw]

    def keys(self, data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of each start in repetition k, and where its walk ends. data has STEPS places after the last start."""
        place, key = starts.astype(np.int64), np.zeros(len(starts), U64)
        read, move, word = np.empty_like(place), np.empty_like(place), np.empty_like(key)
        for step in range(max(self.sampled[k]) + 1):
            # Places are in range, so no check is needed; "clip" spares a copy.
            np.take(data, place, out=read, mode="clip")
            if step in self.sampled[k]:
                key ^= np.take(self.words[k, step], read, out=word, mode="clip")
            place += np.take(self.moves[k, step], read, out=move, mode="clip")
        return mix(key), place


def start_places(data: np.ndarray) -> np.ndarray:
    """Places where windows are seen from: words, characters of scripts beyond Latin, and places after a long run without a space."""
    space = (data == 32) | (data == 0)
    before = np.concatenate(([True], space[:-1]))
    last = np.maximum.accumulate(np.where(space, np.arange(len(data)), -1))
    return np.flatnonzero(~space & (before | (data >= SYMBOLS // 2) | (np.arange(len(data)) - last > RUN)))


class Part:
    """Pieces of some short items, for exact lookup."""

    def __init__(self, numbers: np.ndarray, items: list[np.ndarray], slack: np.ndarray) -> None:
        self.slack = slack
        size = np.array([len(t) for t in items], np.int64)
        piece = size[numbers] // (slack[numbers] + 1)
        self.need = np.zeros(len(items), np.int64)
        self.need[numbers] = size[numbers] // np.maximum(piece, 1) - slack[numbers]
        self.pieces: list[tuple[int, Table]] = []
        for q in sorted(set(piece.tolist())):
            rows = [(k, o) for k in numbers[piece == q].tolist() for o in range(0, len(items[k]) - q + 1, q)]
            own = np.concatenate([grams(items[k][o : o + q], q) for k, o in rows])
            self.pieces.append((q, Table(own, *(np.array(x, np.int64) for x in zip(*rows)))))

    def windows(self, data: np.ndarray, by_size: dict[int, np.ndarray]) -> np.ndarray:
        """Item and diagonal, as one sorted number, wherever enough pieces of an item meet."""
        keys = []
        for q, table in self.pieces:
            if q not in by_size:
                by_size[q] = grams(data, q)
            at, item, offset = table.hits(by_size[q])
            keys.append(item << 40 | (at - offset + (1 << 39)))
        key = np.sort(np.concatenate(keys))
        item = key >> 40
        last = np.arange(len(key)) + self.need[item] - 1
        return key[(last < len(key)) & (key[np.minimum(last, len(key) - 1)] - key <= self.slack[item])]


class Index:
    """A block of items: keys of the long ones' windows, pieces of the short ones, four-character sequences of all."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, t) for i, t in items if t]
        data = [symbols(t) for _, t in self.items]
        self.size = np.array([len(t) for t in data], np.int64)
        self.slack = (MAX_EDITS * self.size).astype(np.int64)
        #: A window stands for copies on so many diagonals.
        self.span = self.slack // 2 + 1
        self.reach = 3 * int(self.size.max(initial=0)) + 4 + STEPS
        self.kinds = [np.unique(kinds(t), return_counts=True) for t in data]
        short = np.flatnonzero(self.size < SHORT)
        self.parts = [Part(short[a : a + PART_ITEMS], data, self.slack) for a in range(0, len(short), PART_ITEMS)]
        self.draws: list[tuple[Walks, list[Table]]] = []
        for (least, steps, samples), limit in zip(DRAWS, [*(d[0] for d in DRAWS[1:]), 1 << 60]):
            own = np.flatnonzero((self.size >= least) & (self.size < limit))
            if len(own):
                self.draws.append(self.tables(steps, samples, own, [data[k] for k in own]))

    def tables(self, steps: int, samples: int, numbers: np.ndarray, items: list[np.ndarray]) -> tuple[Walks, list[Table]]:
        every = np.concatenate([np.append(t, np.zeros(STEPS, np.int64)) for t in items])
        begin = np.concatenate(([0], np.cumsum(self.size[numbers] + STEPS)))
        starts = start_places(every)
        own = np.searchsorted(begin, starts, "right") - 1
        # Half of a walk's steps move on, so starts so near to the end have no key of the item's alone.
        usable = starts + steps // 2 <= begin[own] + self.size[numbers][own]
        count = np.maximum(1, np.bincount(own[usable], minlength=len(numbers)))
        turns = np.clip(-(-KEYS // count), WALKS, MOST_WALKS)
        out, walks = [], Walks(steps, samples, int(turns.max()))
        for k in range(int(turns.max())):
            asked = turns[own] > k
            key, end = walks.keys(every, starts, k)
            # What a walk reads after the item's end isn't the item's.
            inside = asked & (end <= begin[own] + self.size[numbers][own])
            out.append(Table(key[inside], numbers[own[inside]], (starts - begin[own])[inside]))
        return walks, out

    def candidates(self, texts: list[str]) -> np.ndarray:
        """Distinct (text, item, start of the item's window), sorted, of normalised texts."""
        data = np.concatenate([*(x for t in texts for x in (symbols(t), np.zeros(1, np.int64))), np.zeros(0, np.int64)])
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        half, found, by_size = 1 << 39, [np.zeros(0, np.int64)], {}
        padded = np.append(data, np.zeros(STEPS + 1, np.int64))
        starts = start_places(data) if self.draws else None
        for walks, tables in self.draws:
            for own in (starts[a : a + PIECE_STARTS] for a in range(0, len(starts), PIECE_STARTS)):
                for k, table in enumerate(tables):
                    at, item, offset = table.hits(walks.keys(padded, own, k)[0])
                    found.append(item << 40 | (own[at] - offset + half))
        found += [part.windows(data, by_size) for part in self.parts]
        key = np.concatenate(found)
        item = key >> 40
        diagonal = (key & ((1 << 40) - 1)) - half
        diagonal -= diagonal % np.append(self.span, 1)[item]
        key = np.unique(item << 40 | (diagonal + half))
        item, diagonal = self.alike(data, key >> 40, (key & ((1 << 40) - 1)) - half)
        # The middle of a window lies in the copy, so in the copy's text.
        text = np.searchsorted(begin, np.clip(diagonal + self.size[item] // 2, 0, max(0, len(data) - 1)), "right") - 1
        return np.unique(np.column_stack((text, item, diagonal - begin[text])), axis=0)

    def alike(self, data: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows, sorted by item, that have enough of the item's four-character sequences."""
        pad = self.reach
        kind = kinds(np.concatenate((np.zeros(pad, np.int64), data, np.zeros(pad + 3, np.int64))))
        keep = np.ones(len(item), bool)
        present, first = np.unique(item, return_index=True)
        rank = np.zeros(1 << KIND_BITS, np.int32)
        for k, start, stop in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(item)]):
            n, slack, (own, times) = int(self.size[k]), int(self.slack[k]), self.kinds[k]
            least, width = n - 3 - 4 * slack, n + 2 * slack + int(self.span[k])
            if least <= 0:
                continue
            rank[:] = len(own)
            rank[own] = np.arange(len(own))
            limit = np.append(times, 0)
            windows, step = sliding_window_view(kind, width), max(1, WINDOW_CELLS // (width + len(limit)))
            for a in range(start, stop, step):
                b = min(a + step, stop)
                place = rank[windows[np.clip(diagonal[a:b] - slack + pad, 0, len(windows) - 1)]]
                ok = np.count_nonzero(place < len(own), axis=1) >= least
                row = np.arange(np.count_nonzero(ok))[:, None] * len(limit)
                held = np.bincount((row + place[ok]).reshape(-1), minlength=len(row) * len(limit)).reshape(-1, len(limit))
                ok[ok] = np.minimum(held, limit).sum(axis=1) >= least
                keep[a:b] = ok
        return item[keep], diagonal[keep]

    def matches(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each normalised text: item number to least edit distance and its end in the text, of each item in the text."""
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        # Windows of one item that overlap are searched as one.
        areas: list[list[int]] = []
        for n, k, start in self.candidates(texts).tolist():
            size, slack = int(self.size[k]), int(self.slack[k])
            lo, hi = max(0, start - slack), min(len(texts[n]), start + slack // 2 + 1 + size + slack)
            if areas and areas[-1][:2] == [n, k] and lo <= areas[-1][3]:
                areas[-1][3] = max(hi, areas[-1][3])
            else:
                areas.append([n, k, lo, hi])
        for n, k, lo, hi in areas:
            item, text, found, slack = self.items[k][1], texts[n], best[n], int(self.slack[k])
            if found.get(k, (1,))[0] == 0:
                continue
            at = text.find(item, lo, hi)
            if not slack:
                while at >= 0 and not whole(text, at, at + len(item)):
                    at = text.find(item, at + 1, hi)
                if at < 0:
                    continue
            distance, end = (0, at - lo + len(item)) if at >= 0 else edit_search(item, text[lo:hi])
            if distance <= slack and distance < found.get(k, (1 << 60,))[0]:
                found[k] = (distance, lo + end)
        return best


def whole(text: str, start: int, end: int) -> bool:
    """Whether neither end of a range lies between two letters or digits of Latin script."""

    def joins(at: int) -> bool:
        return 0 < at < len(text) and " " not in text[at - 1 : at + 1] and max(text[at - 1 : at + 1]) < "ɐ"

    return not joins(start) and not joins(end)


def edit_search(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any substring of the text, and where the first such ends (bit-parallel)."""
    m = len(item)
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(d0 | up)), up & d0
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | (full & ~(d0 | rise)), rise & d0
        if score < best:
            best, end = score, j + 1
    return best, end


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded rows and characters, streamed. There is one block at least."""
    block, chars = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        text = normalised(row[1] or "")
        if block and (len(block) >= BLOCK_ROWS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row[0], text))
        chars += len(text)
    yield block


def pass_by_pass(rows: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, one) -> Iterator[DataFrame]:
    """one(rows, broadcast index) for each block. All but the last are written to the shared folder, so one index is held at a time."""
    context, before = rows.sparkSession.sparkContext, None
    for block in blocks(benchmark, id_col, text_col):
        if before is not None:
            frame, shared = before
            rows = yield written(rows.sparkSession, frame, "block")
            shared.destroy()
        shared = context.broadcast(Index(block))
        before = one(rows, shared), shared
    yield before[0]


_LEAKS = "id long, item_id long, n_chars long, distance long, ends_at long"


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each item found in each document. n_chars: the normalised item's; ends_at: place in the normalised text."""
    session_defaults(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def one(rows: DataFrame, shared) -> DataFrame:
        def make(batch: pa.RecordBatch):
            index, ids = shared.value, batch.column(0).to_pylist()
            texts = [normalised(t or "") for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in chunks(texts, PIECE_BYTES):
                for i, found in zip(ids[a:b], index.matches(texts[a:b])):
                    rows += [(i, index.items[k][0], len(index.items[k][1]), d, e) for k, (d, e) in sorted(found.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["id", "item_id", "n_chars", "distance", "ends_at"])

        return mapped(rows, make, _LEAKS)

    steps = pass_by_pass(docs, benchmark, item_col, item_text_col, one)
    found = [next(steps)]
    try:
        while True:
            found.append(steps.send(docs))
    except StopIteration:
        return reduce(DataFrame.union, found)


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of documents that hold no item; same columns. Block after block, no join."""
    session_defaults(documents.sparkSession)
    at = documents.columns.index(text_col)

    def one(rows: DataFrame, shared) -> DataFrame:
        def make(batch: pa.RecordBatch):
            texts = [normalised(t or "") for t in batch.column(at).to_pylist()]
            ok = [not found for a, b in chunks(texts, PIECE_BYTES) for found in shared.value.matches(texts[a:b])]
            yield batch.filter(pa.array(ok, pa.bool_()))

        return mapped(rows, make, rows.schema)

    steps = pass_by_pass(documents, benchmark, item_col, item_text_col, one)
    kept = next(steps)
    try:
        while True:
            kept = steps.send(kept)
    except StopIteration:
        return kept
