"""Elkan's bounds against plain exact assignment."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from annalist.llm import clusters


def brute(rows, k, rounds, seed=2, size=64, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    x, c = np.array([v for _, v in kept]), np.array([v for _, v in starts])
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own, least = d.argmin(1), d.min(1)
        if turn < rounds:
            c = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    return sorted(((i, int(a), int(b), int(least[own == a].sum()), int(least.sum()), c[a].tolist()) for (i, _), a, b in zip(kept, own, least)), key=str), c


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2.0) for i, v in rows], "vec_id long, embedding array<float>, id string, own int, v string, upper double").repartition(3)


def random_rows(n, grid, seed):
    rng = random.Random(seed)
    return [(i, [rng.choice(grid) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize(
    "name, rows, k",
    [
        ("spread", random_rows(300, [x / 64 for x in range(-60, 60)], 1), 40),
        ("ties on a coarse grid", [(i, v[:2] + [0.0] * 62) for i, v in random_rows(400, [-0.01, 0.0, 0.01], 2)], 12),
        ("one vector for a third of all", random_rows(100, [-0.5, 0.5], 3) + [(1000 + i, [0.25] * 64) for i in range(50)], 10),
        ("repeated ids and null ids", [(i % 7 if i % 5 else None, v) for i, v in random_rows(120, [-1.0, 0.3, 2.0], 4)], 20),
        ("fewer than centroids", random_rows(5, [0.1, 0.9], 5), 40),
    ],
)
def test_equals_plain_assignment(spark, name, rows, k):
    odd = [(9001, None), (9002, []), (9003, [0.0] * 63), (9004, [0.0] * 65), (9005, [None] + [0.0] * 63), (9006, [float("nan")] + [0.0] * 63), (9007, [float("-inf")] * 64)]
    got = sorted((tuple(r) for r in clusters.cluster(table(spark, rows + odd), clusters=k).collect()), key=str)
    want, _ = brute(rows, k, 5)
    assert got == want


def test_no_vectors(spark):
    assert clusters.cluster(table(spark, [(1, None)])).collect() == [] and clusters.cluster(table(spark, [(1, None)]).limit(0)).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="exact 64-bit distances"):
        clusters.cluster(table(spark, [(1, [1e30] * 64), (2, [0.0] * 64)])).collect()


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(7)
    centres = rng.integers(-400, 400, (20, 64))
    v = (centres[rng.integers(0, 20, 2000)] + rng.integers(-30, 30, (2000, 64))).astype(np.int64)
    now = before = v[:20]
    own, upper, lower, asked = np.zeros(2000, np.int32), np.full(2000, np.inf), np.zeros((2000, 20)), []
    for _ in range(5):
        own, upper, lower, n = clusters.Round(before, now).assign(v, own, upper, lower)
        asked.append(n)
        d = ((v[:, None] - now[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(d)).all()
        before, now = now, np.array([v[own == c].sum(0) // (own == c).sum() if (own == c).any() else now[c] for c in range(20)])
    assert asked[-1] < 0.2 * d.size
