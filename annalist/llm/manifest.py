"""A Merkle manifest of a dataset: a tree of hashes over the rows of each source, and one over the sources.

Rows are hashed in the JVM, ordered by source and id over ranges and numbered by counts of the ranges, so a source of any size spreads over
many parts. The tree is built by an associative monoid: an element is a sparse forest of unresolved nodes, keyed by tree, level and
index, each with the number of nodes of its level. Joining two forests unites their nodes and, whenever all siblings of a run are there (ARITY, or what is
left at the end of a level), replaces them by their parent; the top of a source becomes a leaf of the tree of sources.
A stretch of consecutive rows leaves at most ARITY - 1 open nodes at either end of a level, however long it is. Parts
are folded by executors, then FRAGMENTS stretches of neighbouring parts, and `treeReduce` joins these; the driver gets one forest of
bounded size. Every run that is completed on the way is kept with its nodes.

Proofs descend over the kept runs: the siblings above a run are those of its parent and those above the parent's run. The
inner levels, a 1/ARITY**2 of the rows, are joined one by one; the runs of rows, ARITY rows each, are joined to the level above once.

Defined results: any field may be null and is hashed as `-`; ids are read as long, null ids come first in their source and are never chosen for
tampering; rows that are equal in id and source come in the order of their hashes, equal rows have leaves of their own; an empty text is hashed as
`0:`; an empty table gives an empty table; only the named columns are read; texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import session_defaults, written

#: Nodes of a run.
ARITY = 16
#: Stretches that the last reduction starts with; parts that rows are ordered in at most.
FRAGMENTS, PARTS = 64, 4096
#: The number of the tree over the sources; trees of sources are numbered from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: (tree, level, index) -> (nodes of that level, digest)
Forest = dict[tuple[int, int, int], tuple[int, str]]


def hashed(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def settle(forest: Forest, sources: int, runs: list[tuple[int, int, int, int, list[str]]], fresh: Iterable[tuple[int, int, int]]) -> None:
    """Replace complete runs among the fresh nodes by their parents, upwards; each completed run is noted as (tree, level, run, nodes of the level, digests)."""
    todo = list(fresh)
    while todo:
        tree, level, index = todo.pop()
        if (tree, level, index) not in forest:
            continue
        total, digest = forest[tree, level, index]
        if total == 1:
            if tree != TOP:
                del forest[tree, level, index]
                forest[TOP, 0, tree] = (sources, digest)
                todo.append((TOP, 0, tree))
            continue
        run = index // ARITY
        keys = [(tree, level, k) for k in range(run * ARITY, min(total, run * ARITY + ARITY))]
        if all(k in forest for k in keys):
            digests = [forest.pop(k)[1] for k in keys]
            runs.append((tree, level, run, total, digests))
            forest[tree, level + 1, run] = (-(-total // ARITY), hashed(digests))
            todo.append((tree, level + 1, run))


def join(a: tuple[Forest, list], b: tuple[Forest, list], sources: int) -> tuple[Forest, list]:
    """The monoid's operation; the unit is ({}, []). Order doesn't matter, as nodes carry their places."""
    forest, runs = {**a[0], **b[0]}, a[1] + b[1]
    settle(forest, sources, runs, list(b[0]))
    return forest, runs


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(rows: DataFrame, tamper_every: int, parts: int) -> DataFrame:
    """Written in order: part, place (from 0 in each part), id, source, leaf, changed (the leaf after tampering, null where it is the same)."""
    id_, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    chosen = F.coalesce(F.pmod(F.crc32(id_.cast("long").cast("string").cast("binary")), F.lit(tamper_every)) == 0, F.lit(False))
    plain = leaf([id_.cast("long"), source, lang, n_chars, text])
    other = F.when(chosen & (_lowered(text) != text), leaf([id_.cast("long"), source, lang, n_chars, _lowered(text)]))
    found = rows.select(id_.cast("long").alias("id"), source.alias("source"), plain.alias("leaf"), other.alias("changed"))
    dealt = found.repartitionByRange(parts, "source", "id", "leaf").sortWithinPartitions("source", "id", "leaf")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(rows.sparkSession, dealt.select(F.spark_partition_id().alias("part"), place.alias("place"), "*"), "leaves")


def numbered(found: DataFrame) -> tuple[DataFrame, int]:
    """Written: part, source, tree, shift (from place to index), total, first; and the number of sources.

    One row for each source in each part, so parts plus sources at most. Windows go over the parts of one source, the sources of one part and
    the parts, never over rows.
    """
    spark = found.sparkSession
    counts = written(spark, found.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("place").alias("place")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.select("part", "source", (before - F.col("place")).alias("shift"), F.sum("n").over(Window.partitionBy("source")).alias("total"), (before == 0).alias("first"))
    begun = stretches.groupBy("part").agg(F.count_if("first").alias("begun"))
    offsets = begun.select("part", F.coalesce(F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = F.count_if("first").over(Window.partitionBy("part").orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    placed = stretches.withColumn("own", own).join(offsets, "part").select("part", "source", (F.col("offset") + F.col("own") - 1).alias("tree"), "shift", "total", "first")
    placed = written(spark, placed, "stretches")
    return placed, placed.where("first").count()


NODES = "part int, tree long, level int, index long, total long, digests array<string>, open boolean"


def folded(nodes: DataFrame, sources: int) -> DataFrame:
    """Written: what is left of each part's nodes (open) and the inner runs that were completed on the way, by part, tree, level, index.

    A part's nodes come in order, and only open ones are held. Runs of rows aren't kept, as the rows are.
    """

    def make(batches):
        part, forest = None, {}
        runs: list = []

        def packed(last: bool) -> list[pa.RecordBatch]:
            rows = [(part, tree, level, run, total, digests, False) for tree, level, run, total, digests in runs if level or tree == TOP]
            if last:
                rows += [(part, tree, level, index, total, [digest], True) for (tree, level, index), (total, digest) in forest.items()]
            runs.clear()
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
            names = ["part", "tree", "level", "index", "total", "digests", "open"]
            return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)] if rows else []

        for batch in batches:
            for own, tree, level, index, total, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part:
                    yield from packed(True)
                    part, forest = own, {}
                forest[tree, level, index] = (total, digest)
                settle(forest, sources, runs, [(tree, level, index)])
            yield from packed(False)
        yield from packed(True)

    held = nodes.select("part", "tree", "level", "index", "total", "digest").repartition("part").sortWithinPartitions("part", "tree", "level", "index")
    return written(nodes.sparkSession, held.mapInArrow(make, NODES), "nodes")


def siblings(digests: Column, at: Column) -> Column:
    """The run's others: those before and those after, joined."""
    at = at.cast("int")
    return F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("before"), F.array_join(F.slice(digests, at + 2, F.lit(ARITY)), "").alias("after"))


def tree(rows: DataFrame, tamper_every: int = 5, parts: int | None = None) -> DataFrame:
    """Columns id, leaf, subroot, root, changed, path: before and after of each level up to the root."""
    spark = rows.sparkSession
    session_defaults(spark)
    parts = min(PARTS, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = leaves(rows, tamper_every, parts)
    placed, sources = numbered(found)
    same = (found["part"] == placed["part"]) & found["source"].eqNullSafe(placed["source"])
    placed_rows = found.join(placed, same).select(found["part"], "tree", (F.col("place") + F.col("shift")).alias("index"), "total", "id", "leaf", "changed")
    if not sources:
        return placed_rows.selectExpr("id", "leaf", "leaf as subroot", "leaf as root", "changed", "array(struct(leaf as before, leaf as after)) as path")

    # Up: parts, then stretches of neighbouring parts, then one.
    low = folded(placed_rows.select("part", "tree", F.lit(0).alias("level"), "index", "total", F.col("leaf").alias("digest")), sources)
    stretch = F.floor(F.col("part") * FRAGMENTS / parts).cast("int")
    high = folded(low.where("open").select(stretch.alias("part"), "tree", "level", "index", "total", F.col("digests")[0].alias("digest")), sources)

    def element(nodes) -> list[tuple[Forest, list]]:
        forest = {(n["tree"], n["level"], n["index"]): (n["total"], n["digests"][0]) for n in nodes}
        runs: list = []
        settle(forest, sources, runs, list(forest))
        return [(forest, runs)]

    forest, runs = high.where("open").rdd.mapPartitions(element).treeReduce(lambda a, b: join(a, b, sources))
    ((_, root),) = forest.values()
    # Runs across stretches: at most FRAGMENTS for each level and end.
    last = spark.createDataFrame([(t, level, run, total, d) for t, level, run, total, d in runs if level or t == TOP], "tree long, level int, run long, total long, digests array<string>")
    inner = low.unionByName(high).where("not open").select("tree", "level", F.col("index").alias("run"), "total", "digests").unionByName(last)
    inner = written(spark, inner, "runs")

    # Down: the path of a run is that of its parent node.
    none = F.array().cast("array<struct<before string, after string>>")

    def below(children: DataFrame, above: DataFrame) -> DataFrame:
        """Children that have a run above them, by the parent's place in it."""
        upper = above.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"), F.col("digests").alias("_digests"), F.col("path").alias("_path"))
        joined = children.join(upper, (F.col("tree") == F.col("_tree")) & (F.expr(f"run div {ARITY}") == F.col("_run")))
        path = F.concat(F.array(siblings(F.col("_digests"), F.col("run") % ARITY)), F.col("_path"))
        return joined.select(*children.columns, path.alias("path"))

    tops = placed.where("first").select("tree", "total")
    if sources == 1:
        tops = tops.select("tree", F.lit(root).alias("subroot"), none.alias("path"))
    else:
        above = None
        for level in range(levels(sources) - 1, -1, -1):
            here = inner.where((F.col("tree") == TOP) & (F.col("level") == level)).select("tree", "run", "digests")
            above = here.withColumn("path", none) if above is None else below(here, above)
        upper = above.select(F.col("run").alias("_run"), "digests", F.col("path").alias("_path"))
        at = F.col("tree") % ARITY
        tops = tops.join(upper, F.expr(f"tree div {ARITY}") == F.col("_run")).select("tree", F.col("digests")[at.cast("int")].alias("subroot"), F.concat(F.array(siblings(F.col("digests"), at)), "_path").alias("path"))
    tops = written(spark, tops, "tops")

    row = F.struct("index", "id", "leaf", "changed")
    groups = placed_rows.groupBy("tree", F.expr(f"index div {ARITY}").alias("run"), "total").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    height = levels(placed.agg(F.max("total")).first()[0])
    above = None
    for level in range(height - 1, -1, -1) if height else [0]:
        here = inner.where((F.col("tree") != TOP) & (F.col("level") == level)).select("tree", "run", "total", "digests") if level else groups
        ends = here.where(F.col("total") <= ARITY).join(tops.select("tree", "path"), "tree").select(*here.columns, "path")
        above = ends if above is None else ends.unionByName(below(here.where(F.col("total") > ARITY), above))
    rows_of = above.join(tops.select("tree", "subroot"), "tree").select("subroot", "path", "total", F.transform("rows", lambda r: r["leaf"]).alias("leaves"), F.posexplode("rows").alias("at", "row"))
    own = F.when(F.col("total") > 1, F.array(siblings(F.col("leaves"), F.col("at")))).otherwise(none)
    return rows_of.select("row.id", "row.leaf", "subroot", F.lit(root).alias("root"), "row.changed", F.concat(own, "path").alias("path"))


def levels(nodes: int) -> int:
    """How many levels of runs a tree of so many leaves has."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // ARITY), n + 1
    return n


def verified(proved: DataFrame) -> DataFrame:
    """Columns id, leaf, subroot, root, proof_sha256, folded_root, verified: each leaf, tampered where it was, folded with its proof."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    fold = F.aggregate("path", F.coalesce("changed", "leaf"), lambda have, s: F.sha2(F.concat(s["before"], have, s["after"]), 256))
    rows = proved.select("id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
