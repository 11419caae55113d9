"""Choosing a baseline for a save, and location selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators import hierarchy


def matched(requests: DataFrame, baselines: DataFrame) -> DataFrame:
    """The newest baseline of the same version that isn't after the date, for each request: baseline_id, reference_snapshot_id, baseline_date, `error`.

    requests: request_id, game_version, game_date, and the snapshot and baseline asked for, null if any; baselines: promoted ones, with baseline_id, reference_snapshot_id, game_version, baseline_date.
    """
    asked = requests.withColumnRenamed("reference_snapshot_id", "asked_snapshot").withColumnRenamed("baseline_id", "asked_baseline")
    fits = (F.col("baseline_date") <= F.col("game_date")) & F.coalesce(F.col("asked_snapshot") == F.col("reference_snapshot_id"), F.lit(True)) & F.coalesce(F.col("asked_baseline") == F.col("baseline_id"), F.lit(True))
    # By date first, so that a request's baselines of one date are one row.
    dated = asked.join(baselines, "game_version").where(fits).groupBy("request_id", "baseline_date").agg(F.count("*").alias("n"), F.min(F.struct("baseline_id", "reference_snapshot_id")).alias("b"))
    newest = dated.groupBy("request_id").agg(F.max_by(F.struct("baseline_date", "n", "b"), "baseline_date").alias("x"))
    rows = requests.select("request_id").join(newest, "request_id", "left")
    one = F.col("x.n") == 1
    error = F.when(F.col("x").isNull(), "No promoted reference baseline matches the save version and date").when(~one, "Multiple promoted baselines match; select a reference snapshot explicitly")
    return rows.select("request_id", F.when(one, F.col("x.b.baseline_id")).alias("baseline_id"), F.when(one, F.col("x.b.reference_snapshot_id")).alias("reference_snapshot_id"), F.when(one, F.col("x.baseline_date")).alias("baseline_date"), error.alias("error"))


def proposals(saves: DataFrame, baselines: DataFrame, titles: DataFrame) -> DataFrame:
    """A proposal for each save, or why there is none. saves: request_id, game_version, game_date, reference_snapshot_id, baseline_id, primary_title_id, realm_capital_title_id,
    domain_title_ids; titles: title_id, title_rank, parent_title_id, selectable (of the matched baseline)."""
    found = matched(saves, baselines)
    wanted = saves.select("request_id", F.explode(F.array_distinct(F.concat("domain_title_ids", F.array("primary_title_id", "realm_capital_title_id")))).alias("title_id"))
    absent = wanted.join(titles.select("title_id"), "title_id", "left_anti").groupBy("request_id").agg(F.min("title_id").alias("absent"))
    chain = hierarchy.resolved(saves.select(F.col("realm_capital_title_id").alias("title_id")).distinct(), titles).withColumnRenamed("title_id", "realm_capital_title_id").withColumnRenamed("error", "chain_error")
    rows = saves.select("request_id", "realm_capital_title_id").join(found, "request_id").join(absent, "request_id", "left").join(chain, "realm_capital_title_id", "left")
    error = F.coalesce("error", F.when(F.col("absent").isNotNull(), F.concat(F.lit("Save title is absent from the matched reference baseline: "), "absent")), "chain_error", F.when(F.col("county").isNull() | F.col("barony").isNull(), "Save realm capital does not resolve to a county and barony"))
    return rows.select("request_id", "baseline_id", "baseline_date", *[F.when(error.isNull(), F.col(r)).alias(f"starting_{r}_id") for r in reversed(hierarchy.LADDER)], error.alias("error"))


def options(titles: DataFrame, title_rank: str, parent: str | None = None, search: str | None = None) -> DataFrame:
    """Options of one step of a cascading selector: label, value, parent_title_id; `%` and `_` in the search term stay wildcards."""
    if title_rank not in hierarchy.LADDER:
        raise ValueError(f"Unsupported title rank: {title_rank}")
    wanted: list[Column] = [F.col("title_rank") == title_rank]
    if parent is not None:
        wanted.append(F.col("parent_title_id") == parent)
    if search:
        term = f"%{search.strip()}%"
        wanted.append(F.col("display_name").ilike(term) | F.col("title_id").ilike(term))
    return titles.where(reduce(Column.__and__, wanted)).select(F.col("display_name").alias("label"), F.col("title_id").alias("value"), "parent_title_id")
