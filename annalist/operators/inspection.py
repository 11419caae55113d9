"""Read models: the inspection of titles with everything known of them, their children and warnings, and bookmarks of a baseline."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import hierarchy


@dataclass
class Profile:
    """Tables of one baseline, one row a title (or character) each.

    baseline (one row): baseline_date, support_status, historical_state_complete, reference_snapshot_id; snapshot (one row): reference_snapshot_id, game_version, steam_build_id.
    titles: title_id, display_name, title_rank, parent_title_id, selectable, validation_status, validation_note. states: title_id, holder, holder_status, capital_status,
    validation_status, validation_note. validations: title_id, declaration_status, validation_status, validation_note. adjudications: title_id, resolved_id, evidence_kind,
    review_status. de_jure: title_id, de_jure_liege. tributaries: title_id, suzerain, contract_group. names: title_id, localization_key, display_name. characters: character_id,
    display_name, sex, culture_id, validation_status, validation_note.
    """

    baseline: DataFrame
    snapshot: DataFrame
    titles: DataFrame
    states: DataFrame
    validations: DataFrame
    adjudications: DataFrame
    de_jure: DataFrame
    tributaries: DataFrame
    names: DataFrame
    characters: DataFrame


def _prefixed(rows: DataFrame, prefix: str, key: str) -> DataFrame:
    return rows.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c != key])


def titles(p: Profile) -> DataFrame:
    """A row for each title: hierarchy, baseline, state, holder (a reviewed adjudication's before the declared one), overrides and warnings."""
    one = p.baseline.join(p.snapshot, "reference_snapshot_id")
    if len(one.limit(2).collect()) != 1:
        raise ValueError("one baseline with its snapshot is needed")
    reviewed = _prefixed(p.adjudications.where("review_status = 'reviewed'").drop("review_status"), "adjudicated", "title_id")
    of_title = [_prefixed(p.states, "history", "title_id"), _prefixed(p.validations, "holder", "title_id"), reviewed, p.de_jure, p.tributaries, _prefixed(p.names, "override", "title_id")]
    rows = reduce(lambda held, more: held.join(more, "title_id", "left"), of_title, p.titles)
    person = _prefixed(p.characters.withColumnRenamed("character_id", "holder_character_id"), "character", "holder_character_id")
    holder = F.coalesce("adjudicated_resolved_id", "history_holder")
    known = rows.withColumn("holder_character_id", holder).join(person, "holder_character_id", "left")
    return known.crossJoin(F.broadcast(one)).withColumn("warnings", warnings())  # one is one row


def warnings() -> Column:
    """What is to be reviewed of a title, in the order in which it is shown."""
    told = [F.when(F.col(s) == "warning", F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit("review required")))) for name, s, n in (
        ("Hierarchy", "validation_status", "validation_note"), ("Title history", "history_validation_status", "history_validation_note"),
        ("Holder", "holder_validation_status", "holder_validation_note"), ("Character", "character_validation_status", "character_validation_note"),
    )]
    unloaded = F.when(F.col("history_capital_status") == "not_evaluated", F.lit("Capital: static and scripted capital resolution is not loaded yet"))
    return F.array_compact(F.array(*told, unloaded))


#: Sections of a title's inspection: their columns in order, and what they are ordered by.
SECTIONS = {
    "chain": (("title_id", "display_name", "title_rank", "selectable"), ("-depth",)),
    "children": (("title_id", "display_name", "title_rank", "selectable", "validation_status", "validation_note"), ("display_name", "title_id")),
    "blocks": (("source_block_order", "source_path", "duplicate_classification", "baseline_conflict_fields", "resolution_status", "is_winner"), ("source_block_order",)),
    "laws": (("law_order", "law_id", "law_group_id", "effective_date", "source_declaration_order", "source_path", "source_line_start", "source_line_end", "validation_status", "validation_note"), ("law_order",)),
    "variables": (("variable_name", "value_kind", "text_value", "effective_date", "source_declaration_order", "validation_status", "validation_note"), ("variable_name",)),
    "prestige": (("dynasty_id", "minimum_prestige_level", "value_status", "effective_date", "source_holder_character_id", "source_declaration_order", "helper_source_path", "helper_raw_sha256", "validation_status", "validation_note"), ("effective_date", "source_declaration_order")),
}
#: Entries of one section that a row holds.
PAGE = 1000


def title_chain(nodes: DataFrame) -> DataFrame:
    """owner and its chain with itself, for `sections`. nodes: title_id, parent_title_id, display_name, title_rank, selectable."""
    shown = nodes.select("title_id", "display_name", "title_rank", "selectable")
    return hierarchy.ancestors(nodes.select("title_id"), nodes.select("title_id", "parent_title_id")).join(shown, "title_id").withColumnRenamed("leaf", "owner")


def title_laws(active: DataFrame, definitions: DataFrame) -> DataFrame:
    """owner and its laws in force with where they are defined. active: title_id, law_id and its state; definitions: law_id, law_group_id, source_path, source_line_start, source_line_end."""
    return active.withColumnRenamed("title_id", "owner").join(definitions, "law_id")


def sections(tables: dict[str, DataFrame], page: int = PAGE) -> DataFrame:
    """(owner, page, and an array for each section): everything listed under a title, a page at a time, so that no row grows with a title's fame.

    tables: section to its rows with `owner`. All are tagged and united, shuffled once by owner, numbered within a section and grouped by page. A page holds the entries
    page * n to page * n + page - 1 of each section in its order, an empty array where there are none; owners without entries have no row. Rows without an owner are left out; ties go by the whole entry.
    """
    kinds = {name: [dict(rows.dtypes)[c] for c in SECTIONS[name][0]] for name, rows in tables.items()}
    shapes = {name: "struct<" + ",".join(f"{c}:{t}" for c, t in zip(SECTIONS[name][0], kinds[name])) + ">" for name in tables}

    def tagged(name: str, rows: DataFrame) -> DataFrame:
        fields, order = SECTIONS[name]
        numbers = [F.lit(None).cast("double")] * 2
        words = [F.lit(None).cast("string")] * 2
        for k, c in enumerate(order):
            column = F.col(c.lstrip("-"))
            if dict(rows.dtypes)[c.lstrip("-")] == "string":
                words[k] = column
            else:
                numbers[k] = (-column if c[0] == "-" else column).cast("double")
        entries = [F.struct(*fields).alias(s) if s == name else F.lit(None).cast(shapes[s]).alias(s) for s in tables]
        return rows.where("owner is not null").select("owner", F.lit(name).alias("section"), *(x.alias(f"_{k}") for k, x in enumerate((*numbers, *words))), F.to_json(F.struct(*fields)).alias("_4"), *entries)

    united = reduce(DataFrame.unionByName, [tagged(name, rows) for name, rows in tables.items()]).repartition("owner")
    place = F.row_number().over(Window.partitionBy("owner", "section").orderBy(*[f"_{k}" for k in range(5)])) - 1
    # Both the numbering and the grouping are by owner, so the one shuffle serves them.
    rows = united.withColumn("position", place).withColumn("page", F.floor(F.col("position") / page).cast("int"))
    listed = [F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("position", F.col(s).alias("entry"))))), lambda x: x["entry"]).alias(s) for s in tables]
    return rows.groupBy("owner", "page").agg(*listed)


def children(rows: DataFrame) -> DataFrame:
    """Each title's children in the order of their names: parent_title_id, position, title_id. The places are ranks within a parent."""
    place = F.row_number().over(Window.partitionBy("parent_title_id").orderBy("display_name", "title_id"))
    return rows.where("parent_title_id is not null").select("parent_title_id", place.alias("position"), "title_id")


def bookmarks(members: DataFrame, labels: DataFrame, characters: DataFrame, requirements: DataFrame, packages: DataFrame) -> DataFrame:
    """A row for each bookmark: its label, how many featured characters it has, and what packages it needs in order ('Core game' if none).

    Each side is aggregated before it is joined, so that several requirements don't multiply characters. members: bookmark_id, effective_start_date.
    """
    featured = characters.where("character_kind = 'featured'").groupBy("bookmark_id").agg(F.count("*").alias("featured_count"))
    named = requirements.join(packages.select(F.col("package_id").alias("resolved_package_id"), "display_name"), "resolved_package_id", "left")
    shown = F.when(F.col("resolution_status") == "resolved", F.concat("display_name", F.lit(" ["), "resolved_package_id", F.lit("]"))).otherwise(F.concat("requirement_value", F.lit(" [unresolved]")))
    needs = named.groupBy("bookmark_id").agg(F.array_join(F.array_sort(F.collect_set(shown)), ", ").alias("needs"))
    rows = members.join(labels.select(F.col("localization_key").alias("bookmark_id"), "display_value"), "bookmark_id", "left").join(featured, "bookmark_id", "left").join(needs, "bookmark_id", "left")
    return rows.select("bookmark_id", F.coalesce("display_value", "bookmark_id").alias("display_name"), "effective_start_date", F.coalesce("featured_count", F.lit(0)).alias("featured_count"), F.coalesce(F.nullif("needs", F.lit("")), F.lit("Core game")).alias("dlc_requirements"))
