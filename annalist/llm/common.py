"""Shared pieces of the training-data operators: batching, hashing, shared-folder tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts may be long, so both are bounded.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
MASK = (1 << 64) - 1


def session_defaults(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that a worker's memory doesn't follow text length.

    Spark reads both when a plan runs, after the operator has returned, so they are set for the session and stay.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is set on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/annalist-shared")
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/annalist-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    return path


#: Removes the shuffle files of a query as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder and read it back.

    Lost executors cost only a rerun of the tasks that they had, as the files outlive them. Shuffle files of the step go with it.
    """
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


#: A key with more than this share of the rows is hot; there are fewer hot keys than HEAD. Parts that a hot key is dealt over.
HEAD, SPREAD = 4096, 64


def spread_join(rows: DataFrame, counted: DataFrame, keys: list[str], times: str = "n") -> DataFrame:
    """Inner join of rows with a written table of their keys, one row a key, that has each key's number of rows.

    Hot keys are found by their counts, broadcast (fewer than HEAD of them can have over 1 / HEAD of all rows) and dealt over SPREAD parts.
    """
    total = counted.agg(F.sum(times)).first()[0] or 0
    hot = counted.where((F.col(times) * HEAD > total) & (F.col(times) > HEAD)).select(*keys, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return rows.join(counted, keys)
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = counted.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_part"]).drop("_part")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: Sequence[bytes | str], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about `size` bytes together."""
    first, have = 0, 0
    for k, t in enumerate(texts):
        if k > first and have + len(t) > size:
            yield first, k
            first, have = k, 0
        have += len(t)
    if first < len(texts):
        yield first, len(texts)


def mapped(frame: DataFrame, make: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from make(batch)

    return frame.mapInArrow(run, schema)


def by_group(frame: DataFrame, key: str, make: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """A function of one group of a long key, given as a record batch that has the key first.

    The JVM only sorts, which spills; a worker holds one group, so groups must be bounded. No row ever holds a whole group.
    """
    held = frame.select(key, *[c for c in frame.columns if c != key]).repartition(key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if pieces and b > a and pieces[0].column(0)[0].as_py() != keys[a]:
                    yield from make(joined(pieces))
                    pieces = []
                if b > a:
                    pieces.append(batch.slice(a, b - a))
        if pieces:
            yield from make(joined(pieces))

    return held.mapInArrow(run, schema)


def joined(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pieces[0] if len(pieces) == 1 else pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words drawn by splitmix64 from a seed."""
    return mix((np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed))


class RollingHash:
    """Polynomial hash modulo 2**64 of byte ranges; bytes are first sent to random 64-bit words.

    hash(a, b) = sum of table[byte] * base**(i - a) over a <= i < b, from prefix sums.
    """

    def __init__(self, seed: int) -> None:
        self.table = seeded(256, seed)
        self.base = (int(seeded(1, seed + 77)[0]) | 1) & MASK
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(1024, 1 << int(n).bit_length())
            ones = np.empty(size + 1, U64)
            for name, step in (("up", self.base), ("down", self.inverse)):
                ones[0] = 1
                ones[1:] = U64(step)
                setattr(self, name, np.multiply.accumulate(ones))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of `width` bytes, by its start."""
        return (prefix[width:] - prefix[:-width]) * self.down[: len(prefix) - width]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[data]


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]
