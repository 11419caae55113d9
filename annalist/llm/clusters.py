"""Centroid clustering of vectors by Elkan's bounds, with exact integer results.

Components become integers floor(scale * x), so centroids, distances and sums are exact. Each vector carries an upper bound of the distance to its
own centroid and a lower bound for every centroid; when centroids move, bounds move by as much. A centroid is left out where its lower bound, or half its
distance from the vector's own centroid, exceeds the upper bound; a vector whose upper bound is below half the distance to the nearest other
centroid is left out as a whole. Bounds are rounded to the safe side and compared strictly, so a centroid that ties is never
left out; what decides is the squared integer distance, then the smaller number.

A round is one pass over the vectors in Arrow batches, whose state (vector, cluster, bounds) is written to the shared folder, and one aggregate of
exact sums by cluster. Only the centroids, `clusters` times `size` numbers, pass the driver. Vectors are never shuffled, so neither a common vector nor a
large cluster lands in one task; the state before goes when the next is written.

Defined results: vectors that are null, have another size or hold a null or non-finite component are left out; ids are read as long; equal ids
are told apart by their vectors, null ids come last in the order of starts; repeated rows are rows of their own; with fewer vectors than `clusters` each one starts a
centroid; an empty table gives an empty table; only the named columns are read; components of LIMIT or more after scaling raise an error, as
their squared distances need not fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import mapped, scratch, session_defaults

#: Bound of scaled components: (2 * LIMIT) ** 2 * 64 fits 63 bits.
LIMIT = 1 << 27
#: Relative slack of bounds: far over the error of a double's and of a float's rounding.
DOUBLE, SINGLE = 1e-14, 1e-6


def vectors(table: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """Columns id, v of the vectors that count."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.where(v.isNotNull() & (F.size(v) == size) & sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose id has the smallest sha256 with the seed."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(draw.alias("draw"), "v").orderBy(F.col("draw").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def root_up(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + DOUBLE)


def root_down(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 - DOUBLE)


class Round:
    """What all vectors need to know of one round's centroids."""

    def __init__(self, before: np.ndarray, now: np.ndarray) -> None:
        self.now, self.moved = now, root_up(squares(now, before))
        n = len(now)
        apart = np.array([root_down(squares(np.broadcast_to(c, now.shape), now)) for c in now]) / 2
        self.half = apart
        self.nearest = np.where(np.eye(n, dtype=bool), np.inf, apart).min(axis=1) if n > 1 else np.full(n, np.inf)

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New own, upper, lower, and how many distances were computed."""
        own, upper = own.copy(), (upper + self.moved[own]) * (1 + DOUBLE)
        lower = np.maximum((lower - self.moved) * (1 - DOUBLE), 0.0)
        rows = np.flatnonzero(upper >= self.nearest[own])
        if not len(rows):
            return own, upper, lower, 0
        x, mine, bound = v[rows], own[rows], lower[rows]
        least = squares(x, self.now[mine])
        reach, asked = root_up(least), len(rows)
        bound[np.arange(len(rows)), mine] = root_down(least)
        for c in range(len(self.now)):
            at = np.flatnonzero((mine != c) & (bound[:, c] <= reach) & (self.half[mine, c] <= reach))
            if not len(at):
                continue
            asked += len(at)
            found = squares(x[at], self.now[c])
            bound[at, c] = root_down(found)
            better = (found < least[at]) | ((found == least[at]) & (c < mine[at]))
            at, found = at[better], found[better]
            mine[at], least[at], reach[at] = c, found, root_up(found)
        own[rows], upper[rows], lower[rows] = mine, reach, bound
        return own, upper, lower, asked


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def step(state: DataFrame, turn: Round) -> DataFrame:
    """One round over id, v and, after the first round, own, upper, lower."""
    begun = "own" in state.columns

    def make(batch: pa.RecordBatch):
        n = len(batch)
        if not n:
            return
        v = _matrix(batch.column(1), np.int64)
        if np.abs(v).max() >= LIMIT:
            raise ValueError(f"a scaled component reaches {LIMIT}; exact 64-bit distances need smaller ones")
        if begun:
            own, upper, lower = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4), np.float64)
        else:
            own, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, len(turn.now)))
        own, upper, lower, asked = turn.assign(v, own, upper, lower)
        distance = squares(v, turn.now[own])
        counted = np.zeros(n, np.int64)
        counted[0] = asked
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _lists(v, pa.int32()), pa.array(own, pa.int32()), pa.array(upper), _lists((lower * (1 - SINGLE)).astype(np.float32), pa.float32()), pa.array(distance), pa.array(counted)],
            ["id", "v", "own", "upper", "lower", "distance", "asked"],
        )

    return mapped(state.select("id", "v", *(["own", "upper", "lower"] if begun else [])), make, "id long, v array<int>, own int, upper double, lower array<float>, distance long, asked long")


def moved_centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty ones stay. Sums are exact and added up on the map side first."""
    size = now.shape[1]
    rows = state.groupBy("own").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(size)]).collect()
    out = now.copy()
    for r in rows:
        out[r.own] = [r[f"s{i}"] // r.n for i in range(size)]
    return out


def _removed(spark: SparkSession, path: str) -> None:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def cluster(table: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components)."""
    spark = table.sparkSession
    session_defaults(spark)
    kept = vectors(table, id_col, vector_col, size, scale)
    now = first_centroids(kept, clusters, seed)
    if not len(now):
        return kept.selectExpr("id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "v as centroid").limit(0)
    before, state, path = now, kept, None
    for k in range(rounds + 1):
        path, old = scratch(spark, "clusters"), path
        step(state, Round(before, now)).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema("id long, v array<int>, own int, upper double, lower array<float>, distance long, asked long").parquet(path)
        if old:
            _removed(spark, old)
        if k < rounds:
            before, now = now, moved_centroids(state, now)
    # As many rows as centroids.
    sums = {r.own: r.s for r in state.groupBy("own").agg(F.sum("distance").alias("s")).collect()}
    facts = spark.createDataFrame([(c, s, sum(sums.values()), now[c].tolist()) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.select("id", F.col("own").alias("cluster"), "distance").join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

