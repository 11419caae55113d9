"""Summaries of a run: dashboard, trial summary and its proof, scope rollups, occupancy, active counties, observations over a base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators import replay


def half_even(value: Column, digits: int = 2) -> Column:
    """Rounded in decimal, ties to even. Sums are made in decimal too, so the order of rows doesn't matter."""
    return F.bround(value.cast("decimal(38,18)"), digits).cast("double")


def dashboard(holdings: DataFrame) -> DataFrame:
    """One row over all holdings: counties, duchies, domain size, tax, levies, counties of low control (a missing one counts as 100), mean development. All null without holdings."""
    some = F.count("*") > 0
    named = [F.count_distinct(F.nullif(F.col(c), F.lit(""))) for c in ("County_Name", "Duchy_Name")]
    tax = F.sum(F.coalesce(F.col("Tax"), F.lit(0.0)).cast("decimal(18,4)"))
    return holdings.agg(
        F.when(some, named[0]).alias("counties_total"), F.when(some, named[1]).alias("duchies_held"), F.when(some, F.count("*")).alias("domain_size"), F.when(some, half_even(tax)).alias("total_tax"),
        F.when(some, F.sum(F.coalesce("Levies", F.lit(0)))).alias("total_levies"), F.when(some, F.count_if(F.coalesce("Control", F.lit(100)) <= 25)).alias("control_low_count"),
        F.when(some, half_even(F.sum(F.coalesce("Development", F.lit(0))).cast("decimal(38,18)") / F.count("*"))).alias("development_avg"),
    )


def distribution(rows: DataFrame, column: str, default: str = "Unknown") -> DataFrame:
    """One row with a map from each value to its number of rows. The values are a small dimension."""
    counts = rows.groupBy(F.coalesce(column, F.lit(default)).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("distribution"))


def active(counties: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Counties that no lifecycle row archives."""
    return counties.join(lifecycle.where("not active_in_editor").select("county_id").distinct(), "county_id", "left_anti")


def observed_counties(base: DataFrame, observations: DataFrame) -> DataFrame:
    """The latest observation of each county over its base row; a county without a base row is not added. Equal times: the greater transaction counts."""
    last = replay.latest(observations, ["county_id"], [F.desc("observed_at"), F.desc("transaction_id")])
    fields = ("control", "development", "popular_opinion", "observed_at")
    seen = last.select("county_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return base.join(seen, "county_id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def observed_baronies(base: DataFrame, observations: DataFrame, slots: DataFrame) -> DataFrame:
    """The latest observation of each barony over its holding; a barony without one is added from the observation and its slot's capital flag."""
    last = replay.latest(observations, ["barony_id"], [F.desc("observed_at"), F.desc("transaction_id")])
    fields = ("holding_type", "holder_type", "tax", "levies", "plague_resistance", "observed_at")
    seen = last.select("barony_id", *[F.col(c).alias(f"_{c}") for c in fields])
    over = base.join(seen, "barony_id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])
    new = last.join(base.select("barony_id"), "barony_id", "left_anti").join(slots.select("barony_id", "is_county_capital").dropDuplicates(["barony_id"]), "barony_id")
    own = ("playthrough_id", "barony_id", "county_id", "duchy_id", "barony_name", *fields, "is_county_capital")
    added = new.select(*[F.col(c) if c in own else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    return over.unionByName(added)


def title_summaries(titles: DataFrame, counties: DataFrame, holdings: DataFrame, slots: DataFrame) -> DataFrame:
    """A row for each run and title: its own counts, and baronies, slots and counties of the duchy."""
    held = holdings.where("holding_type <> 'empty'").groupBy("playthrough_id", F.col("duchy_id").alias("title_id")).agg(F.count_if(F.col("holder_type") == "ruler").alias("domain_barony_count"), F.count("*").alias("realm_barony_count"))
    seen = counties.groupBy("playthrough_id", F.col("duchy_id").alias("title_id")).agg(F.count("*").alias("observed_county_count"))
    base = slots.groupBy(F.col("duchy_id").alias("title_id")).agg(F.count("*").alias("base_barony_count"))
    rows = titles.join(held, ["playthrough_id", "title_id"], "left").join(seen, ["playthrough_id", "title_id"], "left").join(base, "title_id", "left")
    zero = ("domain_barony_count", "realm_barony_count", "base_barony_count", "observed_county_count")
    return rows.select("playthrough_id", "title_id", "title_name", "title_status", "de_jure_county_count", "domain_county_count", "realm_county_count", "creation_gold_cost", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])


def run_totals(runs: DataFrame, counties: DataFrame, holdings: DataFrame, slots: DataFrame, duchy_id: str) -> DataFrame:
    """A row for each run: counties and baronies of domain and realm, and the base slots of one duchy."""
    c = counties.groupBy("playthrough_id").agg(F.count("*").alias("county_count"), F.count_if(F.col("ownership_scope") == "domain").alias("domain_county_count"), F.count("*").alias("realm_county_count"))
    h = holdings.groupBy("playthrough_id").agg(F.count_if(F.col("holder_type") == "ruler").alias("domain_barony_count"), F.count_if(F.col("holding_type") != "empty").alias("realm_barony_count"))
    names = ("county_count", "domain_county_count", "realm_county_count", "domain_barony_count", "realm_barony_count")
    rows = runs.select("playthrough_id", "game_version").join(c, "playthrough_id", "left").join(h, "playthrough_id", "left")
    base = slots.agg(F.count_if(F.col("duchy_id") == duchy_id).alias("base_barony_count"))
    return rows.select("playthrough_id", "game_version", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]).crossJoin(base)  # base is one row


def proven(totals: DataFrame, titles: DataFrame, wanted_totals: dict[str, object], wanted_titles: dict[str, dict[str, object]]) -> DataFrame:
    """(playthrough_id, holds): whether a run's totals and titles are those that are wanted."""

    def all_of(wanted: dict[str, object]) -> Column:
        out = F.lit(True)
        for name, value in wanted.items():
            out = out & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
        return out

    each = F.lit(0)
    for title, wanted in wanted_titles.items():
        each = each + F.count_if((F.col("title_id") == title) & all_of(wanted))
    met = titles.groupBy("playthrough_id").agg(each.alias("met"))
    return totals.join(met, "playthrough_id", "left").select("playthrough_id", (all_of(wanted_totals) & (F.coalesce("met", F.lit(0)) == len(wanted_titles))).alias("holds"))


def percentage(part: Column, whole: Column) -> Column:
    """part / whole as a whole percentage, ties to even, and '-' without a whole."""
    return F.when(whole > 0, F.concat(F.bround(part.cast("double") / whole * 100, 0).cast("long").cast("string"), F.lit("%"))).otherwise("-")


def control_status(control: Column) -> Column:
    return F.when(control < 50, "Control watch").otherwise("Stable")


def duchy_scopes(slots: DataFrame, counties: DataFrame, titles: DataFrame) -> DataFrame:
    """A row for each duchy of the base: its name, base and observed counties with names and coverage, and owned, open and all slots.

    Base counties are counted by a pass over slots grouped by county first, so no distinct count is needed.
    """
    by_county = slots.groupBy("duchy_id", "county_id").agg(F.count("*").alias("n"), F.count_if("is_open_barony_slot").alias("open"))
    base = by_county.groupBy("duchy_id").agg(F.count("county_id").alias("base_counties"), F.sum("n").alias("total"), F.sum("open").alias("open"))
    each = counties.groupBy("duchy_id", "county_id").agg(F.min("county_name").alias("county_name"))
    # Names of a duchy's counties: a handful.
    seen = each.groupBy("duchy_id").agg(F.count("county_id").alias("observed_counties"), F.array_join(F.array_sort(F.collect_set("county_name")), ", ").alias("county_names"))
    named = titles.groupBy(F.col("title_id").alias("duchy_id")).agg(F.min("title_name").alias("title_name"))
    rows = base.join(seen, "duchy_id", "left").join(named, "duchy_id", "left").withColumn("observed_counties", F.coalesce("observed_counties", F.lit(0)))
    return rows.select(
        "duchy_id", F.coalesce("title_name", "duchy_id").alias("duchy_name"), F.coalesce("county_names", F.lit("")).alias("county_names"), "base_counties", "observed_counties",
        percentage(F.col("observed_counties"), F.col("base_counties")).alias("county_coverage"), (F.col("total") - F.col("open")).alias("owned"), "open", "total",
    )


def county_rows(counties: DataFrame, slots: DataFrame, holdings: DataFrame) -> DataFrame:
    """A row for each county: occupied of all slots, and whether its control is to be watched."""
    base = slots.groupBy("county_id").agg(F.count("*").alias("slots"))
    held = holdings.groupBy("county_id").agg(F.count_if(F.col("holding_type") != "empty").alias("occupied"))
    rows = counties.join(base, "county_id", "left").join(held, "county_id", "left")
    shown = F.concat_ws("/", F.coalesce("occupied", F.lit(0)).cast("string"), F.coalesce("slots", F.lit(0)).cast("string"))
    return rows.select("county_id", "county_name", "duchy_id", shown.alias("occupied_slots"), control_status(F.col("control")).alias("status"))
