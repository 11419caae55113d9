"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

Sketch: in round i each shingle is thrown into one of T bins with a value i + fraction, a bin keeps its least value; from
round T on round i fills bin i - T only, so that every bin is filled. Rounds stop as soon as a document's bins are full.
Two bins are equal with the sets' similarity as probability and the number of equal bins is concentrated, for small
sets too. Bands of bins are buckets. Documents with equal sets are one node. In each bucket every node is compared with a
centre on full shingle sets, so a bucket within one component costs one comparison a node and never all pairs. Buckets that
then still hold several components are gone through again. In those of up to BUCKET nodes and BUCKET_SHINGLES shingles sketches are
compared in memory, then the full sets of likely pairs of different components; only links that join two components leave it,
fewer than the bucket has nodes. In larger ones nodes outside the main component, if few, are compared with all others; those with many
such nodes, which a passage common to otherwise different documents fills, are cut by bands again, each time by bands of other
groups of the bins, where similar pairs meet again and others no longer do. What has many left after LEVELS cuts is compared node by node until each pair of components has been. A pair at the threshold shares 6.75 of the 16 bands of 3 bins of a cut on average, and none with probability 1.6e-4, so a
pair whose buckets are large at every level is missed with at most 2e-5 and LEVELS times that.

Joins on a component's label or on a bucket's centre may have hot keys. They are left to the adaptive execution's splitting of skewed joins, which is
on by default and needs to stay on; each row of theirs is a few numbers, or a text that is compared.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D after lowering A-Z; a document's set has its
distinct five-word shingles, one shingle of all words if there are fewer, and is empty for null, empty or blank texts, which
are linked with nothing. Rows that repeat an id are one document. A row with a null id gets a null component and isn't kept (deduplicated passes it through).
Empty tables give empty tables. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import U64, RollingHash, by_group, chunks, lowered, mapped, mix, seeded, session_defaults, texts_of, word_ranges, written

WORDS = 5
THRESHOLD = 75
#: Bands and bins a band: a pair at the threshold is missed with probability (1 - 0.75**4)**28 = 2e-5.
BANDS, BINS = 28, 4
T = BANDS * BINS
#: Nodes of a bucket, and shingles of them all (8 bytes each), that are compared in memory; the share of equal bins from which
#: full sets are compared (at the threshold a pair has less with probability 4e-9, binomial); pairs compared at once.
BUCKET, BUCKET_SHINGLES, LIKELY, STEP = 2048, 2_000_000, 0.5, 64
#: In larger buckets up to this many nodes outside the main component are compared with all others; those with more are cut by
#: bands of another grouping of the bins, up to LEVELS in all.
MINOR = 32
LEVELS = 5
CUT_BANDS, CUT_BINS = 16, 3
#: New centres a round of what is left.
CENTRES = 32

_HASH = RollingHash(0xA11A)
_ROUND = seeded(2 * T, 0xF55)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text: (text number, hash), sorted."""
    data = lowered(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    first, last = word_ranges(data)
    owner = np.searchsorted(ends, first, side="right")
    n = len(first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = mix(_HASH.ranges(_HASH.prefix(data), first, last) + (last - first).astype(U64))
    count = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    whole = (np.arange(n) - begin[owner] + words <= count[owner]) | ((np.arange(n) == begin[owner]) & (count[owner] < words))
    at = np.flatnonzero(whole)
    stop = begin[owner[at]] + count[owner[at]]
    value = np.zeros(len(at), U64)
    for k in range(words):
        there = at + k < stop
        value[there] = mix(value[there] * U64(0x9E3779B97F4A7C15) + word[np.minimum(at + k, n - 1)[there]] + U64(k + 1))
    order = np.lexsort((value, owner[at]))
    own, value = owner[at][order], value[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    return own[new], value[new]


def sketch(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Bins of each of n sets, given as (set, element) pairs; an empty set's bins stay at the largest value."""
    empty = U64(0xFFFFFFFFFFFFFFFF)
    bins = np.full((n, T), empty, U64)
    flat = bins.reshape(-1)
    own, val = owner, value
    for i in range(2 * T):
        if not len(own):
            break
        h = mix(val ^ _ROUND[i])
        place = own * T + ((h & U64(0xFFFF)) * U64(T) >> U64(16)).astype(np.int64) if i < T else own * T + (i - T)
        np.minimum.at(flat, place, (U64(i) << U64(48)) | (h >> U64(16)))
        open_sets = (bins == empty).any(axis=1)
        more = open_sets[own]
        own, val = own[more], val[more]
    return bins


def bands(bins: np.ndarray) -> np.ndarray:
    """A 64-bit bucket number for each band."""
    out = np.zeros((len(bins), BANDS), U64)
    for b in range(BANDS):
        x = np.full(len(bins), mix(np.array([b + 1], U64))[0])
        for k in range(BINS):
            x = mix(x * U64(0x9E3779B97F4A7C15) + bins[:, b * BINS + k])
        out[:, b] = x
    return out


def regrouped(level: int) -> Column:
    """Bands of a grouping of the bins that belongs to a level, from the low bytes of the bins."""
    order = np.argsort(seeded(T, 0x6E0 + level))
    return F.array(*[F.xxhash64(F.lit(b), F.concat(*[F.substring("code", int(k) + 1, 1) for k in order[b * CUT_BINS : (b + 1) * CUT_BINS]])) for b in range(CUT_BANDS)])


SIGNED = "id long, n_shingles long, set_id binary, bands array<long>, code binary"


def signatures(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: size and digest of its set, and its buckets."""
    session_defaults(documents.sparkSession)

    def make(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        sizes, digests, buckets, codes = [], [], [], []
        for a, b in chunks(texts):
            own, value = shingles(texts[a:b])
            count = np.bincount(own, minlength=b - a)
            at = np.concatenate(([0], np.cumsum(count)))
            sizes.append(count)
            digests += [hashlib.blake2b(value[s:e].tobytes(), digest_size=16).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            bins = sketch(own, value, b - a)
            buckets.append(bands(bins))
            codes += [row.tobytes() for row in (bins & U64(255)).astype(np.uint8)]
        flat = np.concatenate(buckets).reshape(-1).view(np.int64) if buckets else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(codes, pa.binary())], ["id", "n_shingles", "set_id", "bands", "code"])

    return mapped(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, SIGNED)


@lru_cache(16)
def shingle_set(text: bytes, words: int = WORDS) -> frozenset[tuple[bytes, ...]]:
    """The exact set of a text."""
    w = text.lower().split()
    return frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])


def similar(a: bytes, b: bytes) -> bool:
    x, y = shingle_set(a), shingle_set(b)
    both = len(x & y)
    return bool(x and y) and 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def node_texts(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """texts (id, text) with each text of an id once. repeated: the ids that several rows have.

    Copies of a text are cut to one before the shuffle, so many equal rows are one row to compare.
    """
    if repeated.isEmpty():
        return texts
    once = texts.join(repeated, "id", "left_semi").groupBy("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest")).agg(F.min("text").alias("text")).select("id", "text")
    return texts.join(repeated, "id", "left_anti").unionByName(once)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar. texts: (id, text) of every node in a pair; a node's sets are equal.

    Both joins are on shuffled keys, so AQE splits the rows of a node that many others are compared with.
    """
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def make(batch: pa.RecordBatch):
        ok = [similar(x, y) for x, y in zip(texts_of(batch.column(2)), texts_of(batch.column(3)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return mapped(both, make, "a long, b long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label): the least node that each linked node reaches. Minimum labels over links, then over labels."""
    both = written(spark, links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        # Follow the label's own label, so that long chains take a logarithm of rounds.
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = written(spark, step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels


def near_in_size(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def several_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: label, the bucket's most frequent label `main`, number of nodes outside
    it, and the bucket's size in nodes and in shingles."""
    now = members.drop("label", "main", "minor", "size", "weight").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Two levels of counts, so that a bucket of most nodes never reaches one task as rows.
    each = now.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    held = each.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"), F.sum("w").alias("weight")).where("all > top.k")
    return now.join(held.select("bucket", F.col("top.label").alias("main"), (F.col("all") - F.col("top.k")).alias("minor"), F.col("all").alias("size"), "weight"), "bucket")


def shingle_lists(texts: DataFrame) -> DataFrame:
    """(set_id, shingles): the full set of each text as sorted 64-bit hashes."""

    def make(batch: pa.RecordBatch):
        bodies = texts_of(batch.column(0))
        for a, b in chunks(bodies):
            own, value = shingles(bodies[a:b])
            at = np.searchsorted(own, np.arange(b - a + 1))
            held = [value[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in held], pa.binary()), pa.array(held, pa.binary())], ["set_id", "shingles"])

    return mapped(texts.select("text"), make, "set_id binary, shingles binary").dropDuplicates(["set_id"])


def forest(node: np.ndarray, label: np.ndarray, code: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between similar nodes of different labels, as many as join what is linked; similarity is that of the full sets."""
    links, label, n = [], label.copy(), np.array([len(s) for s in sets])
    for k in range(1, len(node)):
        near = np.flatnonzero((label[:k] != label[k]) & (np.minimum(n[:k], n[k]) * 100 >= np.maximum(n[:k], n[k]) * THRESHOLD))
        alike = np.count_nonzero(code[near] == code[k], axis=1)
        near = near[alike >= LIKELY * T][np.argsort(-alike[alike >= LIKELY * T], kind="stable")]
        # Likeliest first, in blocks: what a link has joined needs no further comparison.
        while len(near):
            now, near = near[:STEP], near[STEP:]
            flat, own = np.concatenate([sets[j] for j in now]), np.repeat(np.arange(len(now)), n[now])
            place = np.minimum(np.searchsorted(sets[k], flat), n[k] - 1)
            both = np.bincount(own[sets[k][place] == flat], minlength=len(now))
            for j in now[100 * both >= THRESHOLD * (n[now] + n[k] - both)].tolist():
                if label[j] != label[k]:
                    links.append((max(int(node[j]), int(node[k])), min(int(node[j]), int(node[k]))))
                    label[label == label[j]] = label[k]
            near = near[label[near] != label[k]]
    return links


def bucket_links(held: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of buckets small enough for memory. A bucket gives fewer links than it has nodes, whatever pairs it compares."""
    own = held.select(F.col("node").alias("id")).distinct()
    lists = shingle_lists(texts.join(own, "id", "left_semi"))
    rows = held.select("bucket", "node", "label").join(nodes.select("node", "set_id", "code"), "node").join(lists, "set_id")

    def make(bucket: pa.RecordBatch):
        node, label = (bucket.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        code = np.frombuffer(b"".join(bucket.column(3).to_pylist()), np.uint8).reshape(len(node), T)
        sets = [np.frombuffer(x.as_buffer(), U64) for x in bucket.column(4)]
        order = np.argsort(node)
        found = forest(node[order], label[order], code[order], [sets[k] for k in order])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    return by_group(rows.select("bucket", "node", "label", "code", "shingles"), "bucket", make, "a long, b long").distinct()


def further_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify of buckets that hold several components, and the members of the buckets that are left."""
    held = several_components(members, labels)
    small = (F.col("size") <= BUCKET) & (F.col("weight") <= BUCKET_SHINGLES)
    few = held.where(~small & (F.col("minor") <= MINOR))
    outside = few.where("label <> main").select("bucket", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))
    pairs = few.join(outside, "bucket").where("label <> other").where(near_in_size("n", "m")).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
    return pairs.union(bucket_links(held.where(small), nodes, texts)).distinct(), held.where(~small & (F.col("minor") > MINOR))


def every_component(spark: SparkSession, large: DataFrame, take: Callable[[DataFrame], None], labels: Callable[[], DataFrame]) -> None:
    """Compare centre by centre until each pair of components of each bucket has been compared."""
    done = None
    while True:
        now = several_components(large, labels())
        # The next nodes outside the main component of each bucket are compared with all other components' nodes.
        fresh = now.where("label <> main")
        if done is not None:
            fresh = fresh.join(done, ["bucket", "node"], "left_anti")
        # The filter on row_number keeps CENTRES rows a bucket before the shuffle too.
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
        chosen = written(spark, fresh.withColumn("rank", rank).where(F.col("rank") <= CENTRES).select("bucket", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other")), "chosen")
        if chosen.isEmpty():
            return
        take(now.join(chosen, "bucket").where("label <> other").where(near_in_size("n", "m")).select(F.col("node").alias("a"), "b").distinct())
        tried = chosen.select("bucket", F.col("b").alias("node"))
        done = written(spark, tried if done is None else done.union(tried), "done")


def centre(order: Column) -> list[Column]:
    """The bucket's centre, its least node by an order: node and size. All numbers, so that the aggregate takes no sort."""
    return [F.min_by("node", order).alias("c_node"), F.min_by("n", order).alias("c_n")]


def shared_buckets(placed: DataFrame, order: Column) -> DataFrame:
    """Members of buckets with two nodes or more, with the bucket's centre: (bucket, node, n, c)."""
    shared = placed.groupBy("bucket").agg(*centre(order), F.count("*").alias("size")).where("size > 1")
    return placed.join(shared.select("bucket", F.struct(F.col("c_node").alias("node"), F.col("c_n").alias("n")).alias("c")), "bucket")


def star_pairs(members: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Each node with its bucket's centre, unless they are known to be of one component."""
    pairs = members.where(F.col("node") != F.col("c.node")).select(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b"), "n", F.col("c.n").alias("m")).where(near_in_size("n", "m")).select("a", "b").distinct()
    return pairs if labels is None else apart(pairs, labels)


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "bucket", "node")


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    signed = written(spark, signatures(documents, id_col, text_col), "signed")
    nodes = written(spark, signed.where("n_shingles > 0 and id is not null").groupBy("set_id").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("code").alias("code")), "nodes")
    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    members = written(spark, shared_buckets(placed, F.col("node")), "members")
    # A node stands for one set: of rows that repeat an id, the text whose set is the node's isn't known, so each different one is tried.
    wanted = members.select(F.col("node").alias("id")).distinct()
    repeated = signed.groupBy("id").agg(F.count("*").alias("_times")).where("_times > 1 and id is not null").select("id")
    texts = written(spark, node_texts(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi"), written(spark, repeated, "repeated")), "texts")
    links = written(spark, verified(star_pairs(members), texts), "links")
    labels = components(spark, links)

    def take(pairs: DataFrame) -> None:
        nonlocal links, labels
        more = written(spark, verified(pairs, texts), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(spark, links)

    for level in range(1, LEVELS + 1):
        small, large = further_pairs(members, labels, nodes, texts)
        large = written(spark, large, "large")
        # Large buckets get another centre: it joins what belongs together and differs from the first one.
        centres = large.groupBy("bucket").agg(*centre(hashed(level))).select("bucket", F.struct(F.col("c_node").alias("node"), F.col("c_n").alias("n")).alias("c"))
        take(small.union(star_pairs(large.drop("c").join(centres, "bucket"), labels)).distinct())
        if large.isEmpty():
            break
        if level == LEVELS:
            every_component(spark, large, take, lambda: labels)
            break
        cut = several_components(large, labels).select("node", "bucket", "n").join(nodes.select("node", F.explode(regrouped(level)).alias("other")), "node")
        deeper = cut.select(F.xxhash64("bucket", "other").alias("bucket"), "node", "n")
        members = written(spark, shared_buckets(deeper, hashed(-level)), "members")
    final = nodes.join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("component_id"))
    return signed.select("id", "n_shingles", "set_id").join(final, "set_id", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents, one of each group; same columns.

    Of rows that repeat a kept id the one with the least hash of its columns stays. Rows with a null id pass.
    """
    spark, key = documents.sparkSession, F.col(id_col).cast("long")
    kept = written(spark, groups(documents, id_col, text_col).where("kept").groupBy(F.col("id").alias("_kept")).agg(F.count("*").alias("_times")), "kept")
    own = documents.withColumn("_id", key)
    once = own.join(kept.where("_times = 1"), own["_id"] == kept["_kept"], "left_semi").select(*documents.columns)
    named = documents.where(key.isNull()).unionByName(once)
    repeated = kept.where("_times > 1")
    if repeated.isEmpty():
        return named
    # Partial aggregates cut an id's rows to one before the shuffle.
    row = F.struct(*documents.columns)
    least = own.join(repeated, own["_id"] == repeated["_kept"], "left_semi").groupBy("_id").agg(F.min_by(row, F.xxhash64(*documents.columns)).alias("_row"))
    return named.unionByName(least.select("_row.*"))
