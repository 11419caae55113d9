"""Sharding by a hierarchical weighted hash tree.

Rows descend from the root to a region, a rack and a shard. At each level every child draws -ln(u) / weight, u being a
hash of (id, child), and the least draw wins, so a child gets a share in proportion to its weight. When a weight changes,
a row moves only if the changed child's draw wins or loses, so movement stays within the subtrees whose weights change.
A shard that is added comes as a region of its own: the only draw that is new is its own, so it takes rows only into itself.

Only SQL functions are used. Slots are numbered gaplessly in each shard: rows equal in id, size and checksum are counted first, so that a
hot group is one row in every shuffle; counts are summed by (shard, part), the parts' offsets over that small table, and groups get
the numbers from their running sum on, which are expanded last, in runs of RUN.

Defined results: ids are read as long, so an id goes to the same shard whatever integer type it has; a null id is hashed as a value of its own; a null text has size 1 and the checksum of no bytes; rows that
repeat an id go to the same shard and get slots of their own; an empty table gives an empty table; only the named columns
are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a shard's rows are numbered in; most rows that one array expands to.
PARTS, RUN = 4096, 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves carry a shard number and a weight; an inner node weighs what its children do."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def balanced(regions: int, racks: int, shards: int) -> Node:
    """A tree of equal shards, numbered from 0 in order."""
    def shard(r: int, k: int, s: int) -> Node:
        return Node(f"{r}/{k}/{s}", shard=(r * racks + k) * shards + s)

    return Node("", tuple(Node(f"{r}", tuple(Node(f"{r}/{k}", tuple(shard(r, k, s) for s in range(shards))) for k in range(racks))) for r in range(regions)))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a region of its own."""
    r = len(tree.children)
    return Node(tree.name, (*tree.children, Node(f"{r}", (Node(f"{r}/0", (Node(f"{r}/0/0", shard=shard, own_weight=weight),)),))))


def _draw(key: Column, child: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of key and child."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(child.name), key), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(child.weight))


def shard_of(key: Column, node: Node) -> Column:
    """The shard of a key, as one expression."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return shard_of(key, node.children[0])
    draws = [_draw(key, c) for c in node.children]
    least = F.least(*draws)
    pairs = list(zip(draws, node.children))
    return reduce(lambda rest, x: F.when(x[0] == least, shard_of(key, x[1])).otherwise(rest), reversed(pairs[:-1]), shard_of(key, pairs[-1][1]))


def assign(documents: DataFrame, tree: Node, new_tree: Node, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """Columns id, size, text_crc32, shard, grown_shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select("*", shard_of(F.col("id"), tree).alias("shard"), shard_of(F.col("id"), new_tree).alias("grown_shard"), F.pmod(F.xxhash64("id", "text_crc32"), F.lit(parts)).cast("int").alias("_part"))
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_part").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    # At most parts x shards rows: a bound that doesn't depend on the data.
    numbered = groups.join(F.broadcast(offsets), ["shard", "_part"]).select("id", "size", "text_crc32", "shard", "grown_shard", "_n", first.alias("_first"))
    runs = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {RUN}"))).alias("_run"))
    place = F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1))
    return runs.select("id", "size", "text_crc32", "shard", "grown_shard", "_first", place.alias("_place")).select("id", "size", "text_crc32", "shard", "grown_shard", (F.col("_first") + F.col("_place")).alias("slot"))
