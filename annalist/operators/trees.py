"""Hash trees of tables: an order-free digest of every part of a table, so that two states are compared by the parts that differ.

A row's line is its values in column order, each `-` if null, else its UTF-8 length, a colon and the value as text. Rows fall into buckets by the first hex
digits of the SHA-256 of their key's line; a bucket's digest is of its rows' digests in sorted order, and every two digits less there is a node over at most 256 others.
With d digits a bucket holds about rows / 16**d digests, so `digits` is to grow with the table: 4 serve some hundred million rows.

Defined results: an empty table has no nodes; rows that repeat count as often as they come; null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 4


def line(columns: Sequence[str]) -> Column:
    """The canonical text of some columns."""
    said = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in said])


def levels(rows: DataFrame, key: Sequence[str], by: Sequence[str] = (), digits: int = DIGITS) -> list[DataFrame]:
    """The tree's levels from its buckets to the roots, of each group: by, prefix, n, sha256. All columns but those of `by` are in the digests."""
    own = F.sha2(line(sorted(c for c in rows.columns if c not in by)), 256)
    bucket = F.substring(F.sha2(line(key), 256), 1, digits).alias("prefix")
    level = rows.select(*by, bucket, own.alias("d")).groupBy(*by, "prefix").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("sha256"))
    out = [level]
    while digits:
        digits = max(0, digits - 2)
        below = F.concat_ws(":", "prefix", "sha256")
        held = level.select(*by, F.substring("prefix", 1, digits).alias("above"), "n", below.alias("d")).groupBy(*by, "above")
        level = held.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("sha256")).withColumnRenamed("above", "prefix")
        out.append(level)
    return out


def tree(rows: DataFrame, key: Sequence[str], by: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """All nodes, as a table that is kept beside the rows."""
    return reduce(DataFrame.unionByName, levels(rows, key, by, digits))


def roots(rows: DataFrame, key: Sequence[str], by: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """by, n, sha256: one digest of each group."""
    return levels(rows, key, by, digits)[-1].drop("prefix")


def differences(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame, key: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """(key, change) of keys whose rows differ: added, removed or changed. Rows are only shuffled in buckets whose digests differ. Both trees are of these rows, without groups."""
    buckets = [t.where(F.length("prefix") == digits).select("prefix", F.col("sha256").alias(f"sha256_{k}")) for k, t in enumerate((old_tree, new_tree))]
    moved = buckets[0].join(buckets[1], "prefix", "full").where("not sha256_0 <=> sha256_1").select("prefix")

    def held(rows: DataFrame, name: str) -> DataFrame:
        mine = rows.select(*key, line(key).alias("_key"), F.substring(F.sha2(line(key), 256), 1, digits).alias("prefix"), F.sha2(line(sorted(rows.columns)), 256).alias("d"))
        few = mine.join(moved, "prefix", "left_semi").groupBy("_key", *key)
        return few.agg(F.array_sort(F.collect_list("d")).alias(name)).select("_key", F.struct(*key).alias(f"{name}_key"), name)

    both = held(old, "was").join(held(new, "now"), "_key", "full").where("not was <=> now")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("was_key", "now_key").alias("k"), change.alias("change")).select("k.*", "change")
