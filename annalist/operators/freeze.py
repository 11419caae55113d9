"""Freezing a blocked report's evidence: the ledger of character warnings and their unread declarations, its digest, and certified definitions.

A ledger is checked before it is written: `problems` must be empty. Digests are roots of hash trees, so that no row holds a ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from annalist.functions import script
from annalist.operators import trees

PARSER = "installed_character_history"


def digest(rows: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """A digest of all rows, or of each group's, whatever their order: n and sha256. key: what deals rows over the hash tree's buckets."""
    return trees.roots(rows, key, by or [])


def shaped(rows: DataFrame, raw: str = "raw_script") -> DataFrame:
    """rows with `shape`, the structure of a block without its values, and digests of both."""
    schema = StructType([*rows.schema.fields, StructField("shape", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(shape=[script.shape(x) for x in batch[raw]])

    return rows.mapInPandas(run, schema).withColumn("raw_sha256", F.sha2(F.col(raw), 256)).withColumn("shape_sha256", F.sha2("shape", 256))


def unread(declarations: DataFrame, source_files: DataFrame, bound: DataFrame, warned: DataFrame, cutoff: int) -> DataFrame:
    """Preserved effects up to a date of warned characters, from the parser run that the report is bound to, with their file's digest.

    declarations: character_id, declaration_order, effective_date, operation_key, resolution_status, source_path, parser_version, raw_script;
    source_files: source_group, relative_path, sha256, parser_run_id; bound: parser_name, parser_run_id, parser_version; warned: character_id.
    """
    files = source_files.where(F.col("source_group") == PARSER).select(F.col("relative_path").alias("source_path"), F.col("sha256").alias("source_sha256"), "parser_run_id")
    run = bound.where(F.col("parser_name") == PARSER).select("parser_run_id", "parser_version")
    mine = declarations.where((F.col("operation_key") == "effect") & (F.col("resolution_status") == "preserved") & (F.col("effective_date") <= cutoff))
    return mine.join(files, "source_path").join(F.broadcast(run), ["parser_run_id", "parser_version"], "left_semi").join(warned.select("character_id"), "character_id", "left_semi")


def ledger(declarations: DataFrame, warned: DataFrame) -> DataFrame:
    """A row for each warned character: its state's digest, how many declarations are unread, and their digest. warned: character_id, validation_status, validation_note and the state's other columns."""
    linked = digest(declarations, ["declaration_order"], ["character_id"]).select("character_id", F.col("n").alias("declaration_count"), F.col("sha256").alias("declarations_sha256"))
    state = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(warned.columns)]), {"ignoreNullFields": "false"}), 256)
    return warned.select("character_id", "validation_status", "validation_note", state.alias("state_sha256")).join(linked, "character_id", "left")


def problems(report: DataFrame, warned: DataFrame, declarations: DataFrame, tree: DataFrame, expected: dict[str, int]) -> DataFrame:
    """What forbids a freeze (rule, subject). report (one row): overall_status, frozen, subject_count of the character finding, steam_build_id and game_version with those of
    the build evidence as found_build_id, found_game_version; tree: path, content_sha256 and kind; expected: files, directories, subjects, declarations."""

    def rule(rows: DataFrame, text: str, subject: Column) -> DataFrame:
        return rows.select(F.lit(text).alias("rule"), subject.cast("string").alias("subject"))

    one = F.lit("report")
    out = rule(report.where("overall_status <> 'blocked'"), "Prerelease freeze requires the reviewed blocked report", one)
    out = out.unionByName(rule(report.where("frozen"), "Readiness report is already frozen", one))
    out = out.unionByName(rule(report.where("not steam_build_id <=> found_build_id"), "Steam build evidence does not match the snapshot", F.col("found_build_id")))
    out = out.unionByName(rule(report.where("not game_version <=> found_game_version"), "Launcher game version does not match the snapshot", F.col("found_game_version")))
    counts = tree.agg(F.count_if(F.col("kind") == "file").alias("f"), F.count_if(F.col("kind") == "directory").alias("d"))
    out = out.unionByName(rule(counts.where((F.col("f") != expected["files"]) | (F.col("d") != expected["directories"])), "Installed game-tree counts changed before freeze", F.concat_ws("/", "f", "d")))
    held = warned.agg(F.count("*").alias("n")).crossJoin(report.select("subject_count"))  # one row each
    out = out.unionByName(rule(held.where("not n <=> subject_count"), "Readiness finding does not match live character warnings", F.col("n")))
    hashes = tree.where("kind = 'file'").select(F.col("path").alias("source_path"), "content_sha256")
    differ = declarations.join(hashes, "source_path", "left").where("not source_sha256 <=> content_sha256").select("source_path").distinct()
    out = out.unionByName(rule(differ, "Parser and full-tree hashes differ", F.col("source_path")))
    lone = warned.select("character_id").join(declarations.select("character_id"), "character_id", "left_anti")
    out = out.unionByName(rule(lone, "Warning subjects and preserved declarations do not reconcile", F.col("character_id")))
    sizes = warned.agg(F.count("*").alias("s")).crossJoin(declarations.agg(F.count("*").alias("d")))  # one row each
    return out.unionByName(rule(sizes.where((F.col("s") != expected["subjects"]) | (F.col("d") != expected["declarations"])), "Residual character warning ledger changed before freeze", F.concat_ws("/", "s", "d")))


def word_uses(files: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, path) of files that hold an id as a whole word. Texts are cut into words once, so each id needs no pass of its own. files: path, content; ids: id."""
    words = F.explode(F.array_distinct(F.split(F.decode("content", "ISO-8859-1"), "[^A-Za-z0-9_]+")))
    return files.select("path", words.alias("id")).join(ids.select("id").distinct(), "id", "left_semi").select("id", "path")


def certified(definitions: DataFrame, levels: DataFrame, uses: DataFrame, expected: DataFrame, allowed: DataFrame) -> DataFrame:
    """Where reviewed exceptions are no longer what was reviewed (rule, subject): their path and body, their levels in order, the files that use them.

    definitions: id, path, raw_sha256; levels: id, level_index, level_id; uses: id, path; expected: id, path, raw_sha256, levels array<string>; allowed: id, path.
    """
    found = definitions.select("id", F.struct("path", "raw_sha256").alias("is"))
    wanted = expected.select("id", F.struct("path", "raw_sha256").alias("was"), F.col("levels").alias("wanted"))
    listed = levels.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level_index", "level_id"))), lambda x: x["level_id"]).alias("levels"))
    rows = wanted.join(found, "id", "left").join(listed, "id", "left")
    changed = F.when(~F.col("is").eqNullSafe(F.col("was")), "definition changed").when(~F.col("levels").eqNullSafe(F.col("wanted")), "levels changed")
    out = rows.select(changed.alias("rule"), F.col("id").alias("subject")).where("rule is not null")
    mine = uses.join(expected.select("id"), "id", "left_semi").select("id", "path").distinct()
    extra, gone = mine.exceptAll(allowed.select("id", "path").distinct()), allowed.select("id", "path").distinct().exceptAll(mine)
    return out.unionByName(extra.unionByName(gone).select(F.lit("consumers changed").alias("rule"), F.concat_ws(":", "id", "path").alias("subject")))


def catalog_labels(rows: DataFrame, labels: DataFrame, exceptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows (id) with their label and status valid, reviewed_orphan or missing, and the problems: ids without a label that no review excepts, excepted ones that have one.

    labels: localization_key, display_name; exceptions: id.
    """
    named = rows.join(labels.select(F.col("localization_key").alias("id"), "display_name"), "id", "left").join(exceptions.select("id", F.lit(True).alias("excepted")).distinct(), "id", "left")
    some, excepted = F.col("display_name").isNotNull(), F.col("excepted").isNotNull()
    told = named.withColumn("validation_status", F.when(some & ~excepted, "valid").when(excepted & ~some, "reviewed_orphan").otherwise("missing"))
    bad = F.when(excepted & some, "reviewed exception has a label").when(~some & ~excepted, "label is missing")
    return told.drop("excepted"), told.select(bad.alias("rule"), F.col("id").cast("string").alias("subject")).where("rule is not null")
