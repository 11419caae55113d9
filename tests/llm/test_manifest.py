"""The Merkle manifest against a tree that is built in plain Python, and the monoid's law."""

from __future__ import annotations

import hashlib
import random
import string
import zlib

import pytest

from annalist.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id string, tree string, leaf string, part string, index string"
EXTRA = ("x", "y", "z", "p", "q")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    if not rows:
        return []
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        held = sorted(((r, leaf(r)) for r in rows if r[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = (held, levels([d for _, d in held]))
    top = levels([trees[s][1][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        held, own = trees[s]
        for i, (r, d) in enumerate(held):
            have = d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                have = leaf((*r[:4], r[4].translate(LOWER)))
            proof = []
            for tree, at in ((own, i), (top, j)):
                for level in tree[:-1]:
                    run, k = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += run[:k] + run[k + 1 :]
                    have = h([*run[:k], have, *run[k + 1 :]])
                    at //= 16
            out.append((r[0], d, own[-1][0], top[-1][0], h(proof), have, have == top[-1][0]))
    return sorted(out, key=str)


CASES = {
    "empty": [],
    "one row": [(5, "a", "en", 3, "Abc")],
    "a run and one": [(i, "a", None, 3, "Abc") for i in range(17)],
    "single rows of many sources": [(i, f"s{i}", "en", 1, "T") for i in range(40)],
    "nulls, ties and repeats": [(i % 300 if i % 7 else None, [None, "", "a", "é", "z"][i % 5], None if i % 3 else "en", None if i % 13 == 0 else i, None if i % 11 == 0 else "" if i % 17 == 0 else f"Abc{i % 50}") for i in range(900)]
    + [(1, "a", None, None, "x")] * 40,
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_a_plain_tree(spark, name):
    rows = CASES[name]
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in manifest.verified(manifest.tree(frame, parts=7)).collect()), key=str)
    assert got == brute(rows)


def test_joining_fragments_is_associative_and_has_a_unit():
    rng = random.Random(5)
    sizes = [1, 40, 300, 16, 17]
    nodes = {(t, 0, k): (n, h([f"{t}/{k}"])) for t, n in enumerate(sizes) for k in range(n)}
    want = levels([levels([nodes[t, 0, k][1] for k in range(n)])[-1][0] for t, n in enumerate(sizes)])[-1][0]
    unit = ({}, [])
    for _ in range(20):
        keys = list(nodes)
        rng.shuffle(keys)
        cut = sorted(rng.sample(range(len(keys)), 2))
        a, b, c = ((manifest.join(unit, ({k: nodes[k] for k in part}, []), len(sizes))) for part in (keys[: cut[0]], keys[cut[0] : cut[1]], keys[cut[1] :]))
        left = manifest.join(manifest.join(a, b, len(sizes)), c, len(sizes))
        right = manifest.join(a, manifest.join(b, c, len(sizes)), len(sizes))
        assert left[0] == right[0] and [digest for _, digest in left[0].values()] == [want]
        assert sorted(left[1]) == sorted(right[1])
        assert manifest.join(a, unit, len(sizes))[0] == a[0]


def test_consecutive_leaves_leave_few_open_nodes():
    total = 100_000
    for a, b in ((0, 50_000), (12_345, 77_777), (99_000, 100_000)):
        forest = {(0, 0, k): (total, "") for k in range(a, b)}
        manifest.settle(forest, 1, [], list(forest))
        assert len(forest) <= 2 * (manifest.ARITY - 1) * manifest.levels(total)
