"""Replay of dated operations into state, and the folds that it is made of. All are grouped aggregates: no collected lists of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEAR = "0"


def last_value(value: Column, order: Column, when: Column) -> Column:
    """Last value by order among the rows that meet a condition; a clear becomes null after the choice, not before."""
    return F.nullif(F.max_by(F.when(when, value), F.when(when, order)), F.lit(CLEAR))


def state(operations: DataFrame, entity: str, order: list[str], key: str, value: str, last: dict[str, str], summed: dict[str, str], cutoff: Column) -> DataFrame:
    """One row for each entity: last values of some keys, sums of others, count of values that aren't numbers."""
    rank = F.struct(*order)
    aggregates = [last_value(F.col(value), rank, F.col(key) == k).alias(out) for out, k in last.items()]
    for out, k in summed.items():
        number = F.expr(f"try_cast({value} AS bigint)")
        aggregates += [F.sum(F.when(F.col(key) == k, number)).alias(out), F.count_if((F.col(key) == k) & number.isNull()).alias(f"{out}_unknown")]
    return operations.where(cutoff).groupBy(entity).agg(*aggregates)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order. Only the rank's winners leave each task (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def in_force(operations: DataFrame, entity: str, order: list[str], value: Column) -> Column:
    """The value in force just before each row: last non-null one of earlier rows."""
    before = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(before)


def overlay(base: DataFrame, observed: DataFrame, key: str, columns: list[str], fixed: tuple[str, ...] = (), insert: bool = True) -> DataFrame:
    """Observed values over a base: null ones leave the base's, fixed columns always do. insert: keys that the base lacks become rows.

    observed has one row a key: `latest` comes before. Repeated keys raise, as they would multiply the base's rows.
    """
    once = F.count("*").over(Window.partitionBy(key)) == 1
    checked = observed.withColumn("_once", F.when(once, True).otherwise(F.raise_error(F.lit("observed key is repeated")).cast("boolean")))
    renamed = checked.where("_once").select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(renamed, key, "full_outer" if insert else "left").select(key, *[F.col(c) if c in fixed else F.coalesce(f"_{c}", c).alias(c) for c in columns])


def keyed_replace(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of existing whose keys aren't in new, and new."""
    return existing.join(new, keys, "left_anti").unionByName(new)
