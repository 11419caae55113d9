"""An ordered set for each key, made by events in order: some replace it, others append a value that it doesn't have yet.

Events that replace start an epoch, numbered by a running count; a value's first event within an epoch is the one that counts. Both are windows over
one dealing of the events by key, so there is one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(events: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """events with epoch and counts (whether the event's value enters the set). events: key, the order columns, value (null: nothing enters).

    starts: true for the first event of each replacement. Events of one replacement come next to each other in the order.
    """
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("epoch", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(so_far))
    first = F.row_number().over(Window.partitionBy(key, "epoch", "value").orderBy(*order)) == 1
    return numbered.withColumn("counts", F.col("value").isNotNull() & first)


def in_force(events: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """What is in each key's set after all events, with `position` from 1."""
    last = F.max("epoch").over(Window.partitionBy(key))
    rows = folded(events, key, order, starts).withColumn("_last", last).where("epoch = _last and counts").drop("_last", "epoch", "counts")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def at_instants(events: DataFrame, instants: DataFrame, key: str, order: list[str]) -> DataFrame:
    """instants with `held`: the values in force just before each, in order. events: as above, and `starts`; instants: key, the order columns and others, at places of their own."""
    every = events.select(key, *order, "value", "starts", F.lit(False).alias("_asks")).unionByName(instants.select(key, *order, F.lit(None).cast("string").alias("value"), F.lit(False).alias("starts"), F.lit(True).alias("_asks")))
    rows = folded(every, key, order, F.col("starts"))
    # An array is no longer than there are different values in an epoch.
    before = Window.partitionBy(key, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.collect_list(F.when(F.col("counts"), F.col("value"))).over(before)
    return instants.join(rows.withColumn("held", held).where("_asks").select(key, *order, "held"), [key, *order])
