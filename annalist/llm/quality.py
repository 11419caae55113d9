"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round and round over the features; each turn fits a shallow tree to one
feature's gradient histogram and adds it, shrunk, to that feature's lookup table. Then the pairs of features whose residuals
interact most get tables of their own in the same way. A score is the sum of one table entry for each feature
and pair, found by binning: no tree is left at scoring time.

The model is fitted on the driver on a bounded sample of labelled rows (TRAIN_ROWS); features of all documents are computed
and scored where the documents are.

Defined results: null and empty texts have the features of an empty text and get a score like any other; without labelled rows
every score is 0.5, with labels of one kind it is their smoothed share; of labels that repeat an id the least counts, null
ids or labels are left out; an empty table gives an empty table; only the named columns are read (good_documents keeps all
others); ids are read as long, a null id counts as not held out; repeated rows give rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import U64, RollingHash, chunks, mapped, mix, session_defaults, texts_of, word_ranges

#: Most labelled rows that are fitted on; those with the least hash of their id.
TRAIN_ROWS = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 4
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, L2 = 80, 40, 0.15, 3, 2.0
FEATURES = (
    "log_bytes", "upper_share", "symbol_share", "digit_share", "line_share", "word_length", "distinct_words", "repeated_words", "distinct_pairs",
    "marked_words", "bare_marks", "line_words", "high_bytes", "exclamation_share", "bar_share",
)

_HASH = RollingHash(0x9A17)


def _byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER_CASE, _DIGIT = _byte_class(bytes(range(65, 91))), _byte_class(bytes(range(97, 123))), _byte_class(bytes(range(48, 58)))
_WORDY = _UPPER | _LOWER_CASE | _DIGIT | _byte_class(bytes(range(128, 256)))
_GAP = _byte_class(bytes((32, *range(9, 14))))
_SYMBOL = ~(_WORDY | _GAP)
_PLAIN_END = _WORDY | _byte_class(b".,;:?'\")")


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text, computed for all texts at once."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[begin[1:] - 1] - total[begin[:-1]]

    upper, lower = share(_UPPER[data]), share(_LOWER_CASE[data])
    lines = share(data == 10)
    first, last = word_ranges(data)
    owner = np.searchsorted(begin, first, "right") - 1
    words = np.bincount(owner, minlength=n)
    some, per_word = np.maximum(size, 1), np.maximum(words, 1)
    out = np.zeros((n, len(FEATURES)))
    distinct, repeated, pairs, marked, bare = (np.zeros(n) for _ in range(5))
    if len(first):
        prefix = _HASH.prefix(data)
        h = mix(_HASH.ranges(prefix, first, last) + (last - first).astype(U64))

        def count_distinct(own: np.ndarray, value: np.ndarray) -> np.ndarray:
            v = np.unique(mix(value + own.astype(U64) * U64(0x9E3779B97F4A7C15)) & U64(~((1 << 16) - 1) & (1 << 64) - 1) | own.astype(U64))
            return np.bincount((v & U64(0xFFFF)).astype(np.int64), minlength=n)[:n]

        distinct = count_distinct(owner, h)
        near = owner[1:] == owner[:-1]
        repeated = np.bincount(owner[1:][near & (h[1:] == h[:-1])], minlength=n)
        pairs = count_distinct(owner[1:][near], mix(h[1:][near] * U64(31) + h[:-1][near]))
        wordy = np.concatenate(([0], np.cumsum(_WORDY[data])))
        letters = wordy[last] - wordy[first]
        marked = np.bincount(owner[(letters > 0) & ~_PLAIN_END[data[last - 1]]], minlength=n)
        bare = np.bincount(owner[letters == 0], minlength=n)
    columns = (
        np.log1p(size), upper / np.maximum(upper + lower, 1), share(_SYMBOL[data]) / some, share(_DIGIT[data]) / some, lines / some, (size - words) / per_word,
        distinct / per_word, repeated / per_word, pairs / np.maximum(words - 1, 1), marked / per_word, bare / per_word, words / (lines + 1), share(data > 127) / some,
        share(data == 33) / some, share(data == 124) / some,
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


@dataclass
class Model:
    """Bin edges of each feature, lookup tables of features and of pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + L2)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a shallow tree over ordered bins: the best LEAVES - 1 cuts, found one after the other."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    cuts = [0, len(g)]
    for _ in range(LEAVES - 1):
        best, where = 1e-9, -1
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                m = int(np.argmax(gain))
                if gain[m] > best:
                    best, where = float(gain[m]), int(k[m])
        if where < 0:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + L2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut on the first feature and one on the second in each half, over a grid; its values and gain."""
    best, values = 0.0, np.zeros(g.shape)
    whole = float(_gain(g.sum(), h.sum()))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            found, total = np.zeros(gg.shape), -whole
            for half in (slice(0, cut), slice(cut, None)):
                a, b = np.cumsum(gg[half].sum(0)), np.cumsum(hh[half].sum(0))
                gain = _gain(a[:-1], b[:-1]) + _gain(a[-1] - a[:-1], b[-1] - b[:-1])
                m = int(np.argmax(gain))
                total += float(gain[m])
                found[half, : m + 1] = a[m] / (b[m] + L2)
                found[half, m + 1 :] = (a[-1] - a[m]) / (b[-1] - b[m] + L2)
            if total > best:
                best, values = total, found.T if flip else found
    return values, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the tables on rows x with labels y (0 or 1). Deterministic."""
    n = len(y)
    share = (float(y.sum()) + 1) / (n + 2)
    model = Model(float(np.log(share / (1 - share))))
    if n < 2 or y.min() == y.max():
        return model
    width = x.shape[1]
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [(np.arange(len(e) + 1) * PAIR_BINS) // (len(e) + 1) for e in model.edges]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size))
            model.tables[k] += step
            total += step[b]
    grid = [c[b] for c, b in zip(model.coarse, bins)]

    def histogram(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = grid[i] * PAIR_BINS + grid[j]
        return tuple(np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))

    ranked = sorted(((-_pair_tree(*histogram(i, j))[1], i, j) for i in range(width) for j in range(i)))[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _pair_tree(*histogram(i, j))[0]
            table += step
            total += step[grid[i], grid[j]]
    return model


def held_out(id_: Column) -> Column:
    """Rows that a model never learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that aren't held out."""
    session_defaults(documents.sparkSession)
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    sample = usable.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # The sample's size is bounded by `rows`, so it may be broadcast.
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def make(batch: pa.RecordBatch):
        every = texts_of(batch.column(2))
        x = [features(every[a:b]) for a, b in chunks(every)]
        if x:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(x).tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    # Rows that repeat an id are cut to one, so that the bound holds for what comes to the driver too.
    found = mapped(texts, make, "id long, y double, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("id").toArrow()
    if not found.num_rows:
        return Model()
    return fit(np.array(found.column("x").to_pylist()), found.column("y").to_numpy())


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, score."""
    session_defaults(documents.sparkSession)

    def make(batch: pa.RecordBatch):
        every = texts_of(batch.column(1))
        x = [model.score(features(every[a:b])) for a, b in chunks(every)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(x) if x else [], pa.float64())], ["id", "score"])

    return mapped(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, score double")


def good_documents(documents: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of documents that score at least `least`; same columns, no join."""
    session_defaults(documents.sparkSession)
    at = documents.columns.index(text_col)

    def make(batch: pa.RecordBatch):
        every = texts_of(batch.column(at))
        keep = [model.score(features(every[a:b])) >= least for a, b in chunks(every)]
        yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return mapped(documents, make, documents.schema)
