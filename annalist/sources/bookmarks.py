"""Bookmark collections and package descriptors: scans, normalisation against a baseline, and feature requirements.

A definition file gives declarations; groups, bookmarks and their characters are filters over them by depth. Last scalar wins
within a block, as in every script catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.sources import script_files

# The feature flags and the packages that reviewed evidence maps them to.
FEATURES = {
    "royal_court": "dlc004_ep1",
    "roads_to_power": "dlc014_ep3",
    "all_under_heaven": "dlc022_ep4",
    "khans_of_the_steppe": "dlc020_ce2",
    "landless_adventurer": "dlc014_ep3",
}
#: A flag that is wanted whether a bookmark names it or not.
ALWAYS_WANTED = ("royal_court",)
CHARACTER_FIELDS = ("history_id", "title", "name", "relation", "type", "difficulty")


def canonical_date(text: Column) -> Column:
    """y.m.d as yyyy-mm-dd with months 1-12 and days 1-31 in any month; null if it isn't such a date."""
    part = [F.regexp_extract(text, r"^(\d+)\.(\d+)\.(\d+)$", k) for k in (1, 2, 3)]
    number = [F.when(p != "", p.cast("int")) for p in part]
    return F.when(number[1].between(1, 12) & number[2].between(1, 31), F.format_string("%04d-%02d-%02d", *number))


def _last(key: str, depth: int) -> Column:
    """The last scalar of that name right inside a block at a depth."""
    here = (F.size("keys") == depth + 1) & (F.get("keys", F.lit(depth)) == key) & (F.col("kind") == "scalar")
    return F.max_by(F.when(here, F.col("value")), F.when(here, F.col("ordinals"))).alias(key)


def _first_raw(key: str, depth: int) -> Column:
    here = (F.size("keys") == depth + 1) & (F.get("keys", F.lit(depth)) == key)
    return F.min_by(F.when(here, F.col("value")), F.when(here, F.col("ordinals"))).alias(key)


def entities(source: DataFrame, kind: str) -> DataFrame:
    """Outermost blocks in file order: entity_kind, entity_id, raw script and lines."""
    rows = script_files.declarations(source, 1).where("kind = 'block'")
    return rows.select(F.lit(kind).alias("entity_kind"), F.element_at("keys", 1).alias("entity_id"), F.element_at("ordinals", 1).alias("ordinal"), F.col("value").alias("raw_script"), "path", "line_start", "line_end")


def groups(source: DataFrame) -> DataFrame:
    """group_id, default_start_date; null dates are warnings."""
    rows = script_files.declarations(source, 2)
    each = rows.groupBy("path", F.element_at("ordinals", 1).alias("at")).agg(F.min(F.element_at("keys", 1)).alias("group_id"), F.max((F.size("keys") == 1) & (F.col("kind") == "block")).alias("block"), _last("default_start_date", 1))
    return each.where("block").select("group_id", canonical_date(F.col("default_start_date")).alias("default_start_date"))


def bookmarks(source: DataFrame) -> DataFrame:
    """One row for each bookmark block; a repeated id gives repeated rows with their count."""
    rows = script_files.declarations(source, 2)
    fields = [_last(k, 1) for k in ("group", "start_date", "is_playable", "recommended", "requires_dlc_flag")]
    each = rows.groupBy("path", F.element_at("ordinals", 1).alias("at")).agg(F.min(F.element_at("keys", 1)).alias("bookmark_id"), F.max((F.size("keys") == 1) & (F.col("kind") == "block")).alias("block"), *fields, _first_raw("weight", 1))
    one = each.where("block")
    counts = one.groupBy("bookmark_id").agg(F.count("*").alias("declarations"))
    flag = [F.coalesce(F.col(k) == "yes", F.lit(False)) for k in ("is_playable", "recommended")]
    return one.join(counts, "bookmark_id").select(
        "bookmark_id", F.coalesce("group", F.lit("")).alias("group_id"), canonical_date(F.col("start_date")).alias("explicit_start_date"),
        flag[0].alias("is_playable"), flag[1].alias("is_recommended"), F.col("weight").alias("weight_script"), F.col("requires_dlc_flag").alias("dlc_flag"), "declarations",
    )


def characters(source: DataFrame) -> DataFrame:
    """Featured characters and those nested one level in them, numbered together in file order within a bookmark."""
    rows = script_files.declarations(source, 4)
    # A character block is a path of one or two `character` keys below the bookmark; its fields are one level deeper.
    deep = F.size("keys") >= 3
    related = deep & (F.get("keys", F.lit(1)) == "character") & (F.get("keys", F.lit(2)) == "character")
    opens = (F.col("kind") == "block") & (F.get("keys", F.lit(1)) == "character") & ((F.size("keys") == 2) | ((F.size("keys") == 3) & related))
    own = F.when(opens, F.size("keys")).when(related & (F.size("keys") == 4), 3).when(deep & (F.size("keys") == 3), 2)
    at = rows.where(F.get("keys", F.lit(1)) == "character").withColumn("level", own).where("level is not null")
    field = F.element_at("keys", -1)
    inner = F.size("keys") == F.col("level") + 1
    picks = [F.max_by(F.when(inner & (field == k) & (F.col("kind") == "scalar"), F.col("value")), F.when(inner & (field == k) & (F.col("kind") == "scalar"), F.col("ordinals"))).alias(k) for k in CHARACTER_FIELDS]
    position = F.min_by(F.when(inner & (field == "position"), F.col("value")), F.when(inner & (field == "position"), F.col("ordinals"))).alias("position")
    one = at.groupBy("path", F.expr("slice(ordinals, 1, level)").alias("at")).agg(F.min(F.element_at("keys", 1)).alias("bookmark_id"), F.max(opens).alias("block"), *picks, position).where("block")
    # Two levels at most and file order: the list of a bookmark's places numbers them without a global sort.
    places = one.groupBy("path", F.element_at("at", 1).alias("top")).agg(F.array_sort(F.collect_list("at")).alias("places"))
    placed = one.withColumn("top", F.element_at("at", 1)).join(places, ["path", "top"])
    two = F.size("at") == 3
    return placed.select(
        "bookmark_id", F.array_position("places", F.col("at")).cast("int").alias("ordinal"),
        F.when(two, F.array_position("places", F.slice("at", 1, 2)).cast("int")).alias("parent_ordinal"),
        F.when(two, "related").otherwise("featured").alias("kind"), *CHARACTER_FIELDS, "position",
    )


def normalised(found: DataFrame, of_groups: DataFrame, baseline_date: str) -> DataFrame:
    """Bookmarks with their effective date, notes and whether they are of a baseline's date."""
    rows = found.join(of_groups.select("group_id", F.col("default_start_date").alias("inherited")), "group_id", "left")
    date = F.coalesce("explicit_start_date", "inherited")
    note = F.concat_ws(
        "; ",
        F.when(F.col("inherited").isNull(), "bookmark group is missing"),
        F.when(date.isNull(), "effective start date is missing"),
        F.when(F.col("explicit_start_date") != F.col("inherited"), "bookmark date disagrees with group date"),
        F.when(F.col("declarations") > 1, "duplicate bookmark declaration requires review"),
    )
    return rows.select(
        "bookmark_id", "group_id", "explicit_start_date", F.coalesce(date, F.lit("0000-00-00")).alias("effective_start_date"), "is_playable", "is_recommended", "weight_script",
        F.when(note == "", "valid").otherwise("warning").alias("validation_status"), F.nullif(note, F.lit("")).alias("validation_note"), F.coalesce(date == baseline_date, F.lit(False)).alias("at_baseline"),
    )


def validated_characters(rows: DataFrame, states: DataFrame, titles: DataFrame, labels: DataFrame) -> DataFrame:
    """Featured characters must have a history state (character_id), a title (title_id) and a label (localization_key)."""
    for column, known, key, mark in (("history_id", states, "character_id", "_h"), ("title", titles, "title_id", "_t"), ("name", labels, "localization_key", "_n")):
        ids = known.select(F.col(key).alias(f"{mark}k")).distinct().withColumn(mark, F.lit(True))
        rows = rows.join(ids, rows[column] == ids[f"{mark}k"], "left").drop(f"{mark}k")
    featured = F.col("kind") == "featured"
    note = F.concat_ws("; ", F.when(featured & F.col("_h").isNull(), "history character is missing"), F.when(featured & F.col("_t").isNull(), "featured title is missing"), F.when(featured & F.col("_n").isNull(), "name localization is missing"))
    return rows.withColumn("validation_status", F.when(note == "", "valid").otherwise("warning")).withColumn("validation_note", F.nullif(note, F.lit(""))).drop("_h", "_t", "_n")


def requirements(found: DataFrame) -> DataFrame:
    """Feature flags of bookmarks, resolved to packages by the reviewed mapping."""
    known = F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair])
    package = F.try_element_at(known, F.col("dlc_flag"))
    return found.where("dlc_flag is not null").select(
        "bookmark_id", F.lit("requires_dlc_flag").alias("requirement_kind"), F.col("dlc_flag").alias("requirement_value"), F.when(package.isNull(), "raw_flag").otherwise("resolved").alias("resolution_status"),
        F.when(package.isNull(), "No reviewed flag-to-package mapping exists").otherwise(F.concat(F.lit("Reviewed feature mapping to "), package)).alias("validation_note"), package.alias("resolved_package_id"),
    )


def packages(source: DataFrame) -> DataFrame:
    """Descriptors below dlc/<package>/: scalars, digest and whether the descriptor names its own folder."""
    rows = script_files.declarations(source, 1).where("kind = 'scalar'")
    key = F.element_at("keys", 1)
    picks = [F.max_by(F.when(key == k, F.col("value")), F.when(key == k, F.col("ordinals"))).alias("named_path" if k == "path" else k) for k in ("name", "path", "steam_id", "pops_id", "msgr_id")]
    fields = rows.groupBy("path").agg(*picks)
    digests = source.select("path", F.sha2("content", 256).alias("source_sha256"))
    package = F.regexp_extract("path", r"(?:^|/)?([^/]+)/[^/]+\.dlc$", 1)
    same = F.coalesce((F.col("named_path") == F.concat(F.lit("dlc/"), package)) & (F.col("pops_id") == F.concat(F.lit("ck3_"), package)), F.lit(False))
    return digests.join(fields, "path", "left").select(package.alias("package_id"), F.coalesce("name", package).alias("display_name"), "steam_id", "pops_id", "msgr_id", F.col("path").alias("source_path"), "source_sha256", same.alias("identity_matches"))


def package_problems(found: DataFrame, of_bookmarks: DataFrame) -> DataFrame:
    """Wanted packages without exactly one descriptor, and descriptors of another identity."""
    spark = found.sparkSession
    mapping = spark.createDataFrame(list(FEATURES.items()), "dlc_flag string, package_id string")
    flags = of_bookmarks.select("dlc_flag").union(spark.createDataFrame([(f,) for f in ALWAYS_WANTED], "dlc_flag string"))
    wanted = mapping.join(flags.distinct(), "dlc_flag", "left_semi").select("package_id").distinct()
    counts = wanted.join(found.groupBy("package_id").agg(F.count("*").alias("n"), F.min("identity_matches").alias("same")), "package_id", "left")
    bad = counts.select("package_id", F.when(F.coalesce("n", F.lit(0)) != 1, "descriptor count").when(~F.col("same"), "descriptor identity mismatch").alias("rule")).where("rule is not null")
    return bad.select("rule", F.col("package_id").alias("subject"))
