"""Pointer doubling: where each node of a table of pointers leads to in the end, in as many rounds as the logarithm of the longest way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.session import dropped, tidied, written


def resolved(edges: DataFrame) -> DataFrame:
    """(node, end, along, loose, cyclic) of every node. edges: node (unique, not null), next (null at an end), along (an array or a text that the edge adds, or null).

    end: the last node that exists on the way; along: what the edges followed add, joined in order; loose: the pointer out of the end, to a node that
    doesn't exist; cyclic: the way runs in a circle, then the other columns are of no use.

    Each round joins a node to what lies beyond its stretch, so stretches double. Wherever a way of more than 2**k nodes ends, one of its nodes ends in
    round k + 1; so when a round settles no node, all that are left run in circles, and no stretch is ever over four times the longest way that ends.
    Each round's table is written to the shared folder and replaces that of the round before: a round never runs those before it again. A node that many point to makes a skewed join, which AQE splits.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["along"]
    none = F.lit("") if kind == "string" else F.array().cast(kind)
    state = written(spark, edges.select("node", F.col("node").alias("end"), "next", F.coalesce("along", none).alias("along"), F.lit(None).cast("string").alias("loose")), "pointers")
    with tidied(spark):
        twice = not state.groupBy("node").count().where("count > 1").isEmpty()
    if twice:
        raise ValueError("a node has several pointers")
    left, before = state.where("next is not null").count(), -1
    while left not in (0, before):
        beyond = state.select(F.col("node").alias("next"), F.col("end").alias("_end"), F.col("next").alias("_next"), F.col("along").alias("_along"), F.col("loose").alias("_loose"), F.lit(True).alias("_there"))
        met = state.where("next is not null").join(beyond, "next", "left")
        there = F.col("_there").isNotNull()
        moved = met.select(
            "node",
            F.coalesce("_end", "end").alias("end"),
            F.col("_next").alias("next"),
            F.concat("along", F.coalesce("_along", none)).alias("along"),
            F.when(there, F.col("_loose")).otherwise(F.col("next")).alias("loose"),
        )
        earlier, state = state, written(spark, state.where("next is null").unionByName(moved), "pointers")
        dropped(earlier)
        before, left = left, state.where("next is not null").count()
    return state.select("node", "end", "along", "loose", F.col("next").isNotNull().alias("cyclic"))
