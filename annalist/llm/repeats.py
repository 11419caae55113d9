"""Removal of repeated byte strings by a depth-limited suffix sort.

A suffix needs sorting only through its first DEPTH bytes, and suffixes in equal groups at that depth are exactly the
repeated windows. A radix sort groups them digit by digit, most significant first, and a suffix leaves it as soon as its group is a
single one. One row a suffix would be many times the text, so the first two steps sort many suffixes as one:

1. Partition. A window's anchor is the leftmost of the least hashes of its GRAM-byte grams. Equal windows have equal anchors at equal places, so
   windows with the same anchor gram form a partition that no equal window is outside of. A partition has about DEPTH / 80 times fewer
   anchors than windows; grams that occur once are single groups and leave.
2. Equal contexts. An anchor's context is the bytes that windows with this anchor can reach. Anchors with the same context stand for
   the same windows: all of these are in groups of two or more at full depth, without looking at any of them.
3. Radix passes. In partitions with different contexts one anchor of each context sends its bytes. The windows of up to GROUP contexts are sorted in
   memory by digits of DIGIT bytes from the first to the last; each pass splits the groups that are left, and single windows leave. A larger
   partition is dealt as rows by window, with partial aggregation, its digits being taken as two halves at once.

Digits and contexts are compared by 64-bit hashes: DEPTH / DIGIT of them for a window in memory, two for one dealt as a row, and for a context a
cryptographic one besides its gram's. What travels is one number for each anchor,
then a few windows; texts are joined with what was found about them by document. Joins on grams deal hot grams over many tasks.

Defined results: null text is an empty text; matches never cross documents but may overlap; rows that repeat a document count
as further copies; rows are told apart by (id, text), rows equal in both get equal results; a null id is a document of its
own kind, as any other value; texts under DEPTH bytes keep everything; an empty table gives an empty table; only the named
columns are read; ids are read as long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import CHUNK_BYTES, U64, RollingHash, by_group, chunks, mapped, mix, session_defaults, spread_join, texts_of, written

DEPTH = 200
GRAM = 40
#: Bytes of a digit of the passes in memory.
DIGIT = 40
#: Contexts of one anchor that are compared in memory, of at most 2 * DEPTH bytes each.
GROUP = 4096

_A = RollingHash(0x0511)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Anchors:
    """The anchors of one text: places, gram hashes and the windows that each stands for (starts lo..hi)."""

    def __init__(self, data: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> None:
        self.n, self.depth = len(data), depth
        if self.n < depth:
            self.at = self.lo = self.hi = np.zeros(0, np.int64)
            self.gram = np.zeros(0, U64)
            return
        self.prefix = _A.prefix(data)
        h = mix(_A.windows(self.prefix, gram))
        width = depth - gram + 1
        least = sliding_min(h, width)
        starts = len(least)
        # A gram is an anchor if it is the leftmost least of some window. Follow the windows from left to right: the anchor of
        # window s is the first place >= s whose hash is the window's least.
        value_change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        at, lo, hi = [], [], []
        ends = np.append(value_change[1:], starts)
        for s, e in zip(value_change.tolist(), ends.tolist()):
            m = least[s]
            places = s + np.flatnonzero(h[s : e - 1 + width] == m)
            first = s
            for p in places.tolist():
                if first >= e:
                    break
                if p < first:
                    continue
                last = min(p, e - 1)
                at.append(p)
                lo.append(first)
                hi.append(last)
                first = last + 1
        self.at, self.lo, self.hi = (np.array(x, np.int64) for x in (at, lo, hi))
        self.gram = h[self.at]

    def contexts(self, text: bytes) -> np.ndarray:
        """Hash of all bytes that the anchor's windows cover, with the anchor's place in them."""
        out = np.zeros(len(self.at), U64)
        for k, (p, a, b) in enumerate(zip(self.at.tolist(), self.lo.tolist(), (self.hi + self.depth).tolist())):
            out[k] = int.from_bytes(hashlib.blake2b(text[a:b], digest_size=8, salt=(p - a).to_bytes(4, "little")).digest(), "little")
        return out


def window_halves(data: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The two digits of a window that is dealt as a row: its halves."""
    prefix, middle = _A.prefix(data), starts + depth // 2
    return mix(_A.ranges(prefix, starts, middle)), mix(_A.ranges(prefix, middle, starts + depth))


def spans_of(ranges: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows as maximal spans, sorted."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    first = np.flatnonzero(new)
    return np.column_stack((ranges[first, 0], reach[np.append(first[1:], len(ranges)) - 1]))


def without(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in spans.tolist():
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out)


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, text: the key tells rows apart that repeat an id with another text."""
    return documents.select(F.col(id_col).cast("long").alias("id"), F.pmod(F.xxhash64(text_col), F.lit((1 << 31) - 1)).cast("int").alias("key"), F.col(text_col).alias("text"))


_DOCS = "id long, key int, n_bytes long, sha256 string, at array<int>, gram array<long>, context array<long>"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32) if kind == pa.int32() else values.astype(U64).view(np.int64), kind))


def anchored(texts: DataFrame) -> DataFrame:
    """A row for each document with its anchors."""

    def make(batch: pa.RecordBatch):
        every = texts_of(batch.column(2))
        for a, b in chunks(every, 2 * CHUNK_BYTES):
            at, gram, context = [], [], []
            for text in every[a:b]:
                data = np.frombuffer(text, np.uint8)
                found = Anchors(data)
                for out, x in ((at, found.at), (gram, found.gram), (context, found.contexts(text))):
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(t) for t in every[a:b]], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in every[a:b]], pa.string()), _lists(at, pa.int32()), _lists(gram, pa.int64()), _lists(context, pa.int64()),
                ],
                ["id", "key", "n_bytes", "sha256", "at", "gram", "context"],
            )

    return mapped(texts, make, _DOCS)


#: What is known of an anchor: all its windows are repeated; they are, and it sends them for others; they are to be looked up.
ALL, ALL_AND_SENDS, ASKS = 1, 2, 3


def standings(docs: DataFrame) -> DataFrame:
    """(id, key, found array<struct<at, state>>) of documents with anchors that occur more than once."""
    spark = docs.sparkSession
    anchors = docs.select("id", "key", F.explode(F.arrays_zip("at", "gram", "context")).alias("x")).select("id", "key", "x.*")
    # Partial aggregates before each shuffle keep a gram that is in every document from reaching one task as rows.
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1")
    common = written(spark, grams.select("gram", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "grams")
    again = written(spark, spread_join(anchors, common, ["gram"]).drop("n"), "again")
    alike = again.where("not mixed").select("id", "key", "at", F.lit(ALL).alias("state"))
    several = again.where("mixed").select("id", "key", "at", "gram", "context")
    # A number for the place, as a least number takes no sort; two places with one number would only both send.
    place = F.xxhash64("id", "key", "at")
    classes = written(spark, several.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("first")), "classes")
    state = F.when(F.col("n") == 1, ASKS).when(F.col("first") == place, ALL_AND_SENDS).otherwise(ALL)
    other = spread_join(several, classes, ["gram", "context"]).select("id", "key", "at", state.alias("state"))
    # Rows that repeat a document bring its anchors again: one row an anchor, then one a document.
    each = alike.unionByName(other).groupBy("id", "key", "at").agg(F.max("state").alias("state"))
    return each.groupBy("id", "key").agg(F.collect_list(F.struct("at", "state")).alias("found"))


_ASKING = "id long, key int, n_bytes long, text binary, starts array<int>, ends array<int>, gram array<long>, lo array<int>, context array<binary>, asks array<boolean>"


def looked_at(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with something found: spans known to be repeated, and contexts to send."""
    rows = texts.alias("t")
    held = rows.join(found.alias("f"), F.col("t.id").eqNullSafe(F.col("f.id")) & (F.col("t.key") == F.col("f.key"))).select("t.id", "t.key", F.coalesce("t.text", F.lit("")).alias("text"), "f.found")

    def make(batch: pa.RecordBatch):
        every, lists = texts_of(batch.column(2)), batch.column(3)
        offsets, flat = lists.offsets.to_numpy(), lists.values
        at_all, state_all = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for a, b in chunks(every, 2 * CHUNK_BYTES):
            s_, e_, gram, lo, context, asks = [], [], [], [], [], []
            for k in range(a, b):
                text = every[k]
                anchors = Anchors(np.frombuffer(text, np.uint8))
                s, e = offsets[k], offsets[k + 1]
                # Rows that repeat a document bring its anchors several times.
                state = np.zeros(len(anchors.at), np.int64)
                np.maximum.at(state, np.searchsorted(anchors.at, at_all[s:e]), state_all[s:e])
                full = (state == ALL) | (state == ALL_AND_SENDS)
                known = spans_of(np.column_stack((anchors.lo[full], anchors.hi[full] + DEPTH)))
                sends = np.flatnonzero(state >= ALL_AND_SENDS)
                for out, v in ((s_, known[:, 0]), (e_, known[:, 1]), (gram, anchors.gram[sends]), (lo, anchors.lo[sends])):
                    out.append(v)
                context.append([text[x:y] for x, y in zip(anchors.lo[sends].tolist(), (anchors.hi[sends] + DEPTH).tolist())])
                asks.append((state[sends] == ASKS).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(t) for t in every[a:b]], pa.int64()), pa.array(every[a:b], pa.binary()),
                    _lists(s_, pa.int32()), _lists(e_, pa.int32()), _lists(gram, pa.int64()), _lists(lo, pa.int32()), pa.array(context, pa.list_(pa.binary())), pa.array(asks, pa.list_(pa.bool_())),
                ],
                ["id", "key", "n_bytes", "text", "starts", "ends", "gram", "lo", "context", "asks"],
            )

    return mapped(held, make, _ASKING)


def context_windows(contexts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every window of some contexts: context number, start in it, start in their bytes, and those bytes."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    count = np.maximum(size - DEPTH + 1, 0)
    own = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return own, start, start + np.repeat(np.cumsum(size) - size, count), data


def repeated_windows(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows, given by their starts in the data, occur more than once: radix passes over digits, most significant first."""
    prefix, out = _A.prefix(data), np.zeros(len(start), bool)
    left, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for at in range(0, DEPTH, DIGIT):
        first = start[left] + at
        digit = mix(_A.ranges(prefix, first, first + min(DIGIT, DEPTH - at)))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        stays = np.bincount(group)[group] > 1 if len(group) else new
        left, group = left[stays], group[stays]
    out[left] = True
    return out


_RANGES = "id long, key int, start int, end int"


def compared(sent: DataFrame) -> DataFrame:
    """Ranges of the asking contexts that are repeated. sent: id, key, gram, lo, context, asks."""
    sizes = written(sent.sparkSession, sent.groupBy("gram").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("gram", "n"), "sizes")
    held = spread_join(sent, sizes, ["gram"])
    few = held.where(F.col("n") <= GROUP).select("gram", "id", "key", "lo", "context", "asks")

    def within(batch: pa.RecordBatch):
        lo, asks = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
        own, start, place, data = context_windows(batch.column(4).to_pylist())
        at = np.flatnonzero(repeated_windows(data, place) & asks[own])
        # Rows follow each other by context, then by start: a run ends where either jumps.
        cut = np.flatnonzero(np.concatenate((np.full(min(len(at), 1), True), (np.diff(own[at]) != 0) | (np.diff(start[at]) != 1))))
        first, last = at[cut], at[np.append(cut[1:], len(at)) - 1] if len(at) else at
        mine = own[first]
        take = pa.array(mine)
        ends = [(start[x] + lo[mine] + more).astype(np.int32) for x, more in ((first, 0), (last, DEPTH))]
        yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), *map(pa.array, ends)], ["id", "key", "start", "end"])

    def windows(batch: pa.RecordBatch):
        lo, asks = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
        own, start, place, data = context_windows(batch.column(4).to_pylist())
        w1, w2 = window_halves(data, place)
        take = pa.array(own)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((start + lo[own]).astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(asks[own])], ["id", "key", "start", "w1", "w2", "asks"])

    many = mapped(held.where(F.col("n") > GROUP).select("id", "key", "gram", "lo", "context", "asks"), windows, "id long, key int, start int, w1 long, w2 long, asks boolean")
    twice = many.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("w1", "w2")
    single = many.where("asks").join(twice, ["w1", "w2"]).select("id", "key", "start", (F.col("start") + DEPTH).alias("end"))
    return by_group(few, "gram", within, _RANGES).unionByName(single)


_DONE = "id long, key int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>"


def finished(rows: DataFrame) -> DataFrame:
    def make(batch: pa.RecordBatch):
        removed, n_spans, digest, lists = [], [], [], []
        for text, starts, ends, more in zip(texts_of(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
            ranges = [*zip(starts, ends), *((r["start"], r["end"]) for r in more or ())]
            spans = spans_of(np.array(ranges, np.int64).reshape(-1, 2))
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            n_spans.append(len(spans))
            digest.append(hashlib.sha256(without(text, spans)).hexdigest())
            lists.append(spans.tolist())
        cols = [pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(lists, pa.list_(pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], [c.split()[0] for c in _DONE.split(", ")])

    return mapped(rows, make, _DONE)


def removal(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that go)."""
    spark = documents.sparkSession
    session_defaults(spark)
    texts = _texts(documents, id_col, text_col)
    docs = written(spark, anchored(texts), "anchors")
    found = written(spark, standings(docs), "standings")
    asking = written(spark, looked_at(texts, found), "asking")
    sent = asking.select("id", "key", F.explode(F.arrays_zip("gram", "lo", "context", "asks")).alias("x")).select("id", "key", "x.*")
    hits = written(spark, compared(sent), "ranges").distinct().groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    a, h = asking.alias("a"), hits.alias("h")
    joined = a.join(h, F.col("a.id").eqNullSafe(F.col("h.id")) & (F.col("a.key") == F.col("h.key")), "left").select("a.id", "a.key", "a.n_bytes", "a.text", "a.starts", "a.ends", "h.more")
    done = finished(joined).alias("d")
    d = docs.select("id", "key", "n_bytes", "sha256").alias("o")
    once = F.col("o.id").eqNullSafe(F.col("f.id")) & (F.col("o.key") == F.col("f.key"))
    clean = d.join(found.select("id", "key").alias("f"), once, "left_anti").select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"), F.array().cast("array<array<int>>").alias("spans"))
    return clean.unionByName(done.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"))
