"""Readiness of a baseline: findings by a registry of rules, binding of the evidence that they were made from, and the report read back.

Every rule is a count over the evidence tables, made as a row; what a count means (blocking, passed, accepted, informational) is said once, by
the rule's mode. Tables that several rules ask about are read once, with conditional counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import replay, trees

# Expected parsers and their versions.
PARSERS = {
    "installed_bookmarks": "1.2.0", "installed_character_history": "1.10.0", "installed_cultures": "1.1.0", "installed_dynasties": "1.0.0", "installed_dynasty_houses": "1.0.0", "installed_faiths": "1.0.0",
    "installed_governments": "1.0.0", "installed_landed_titles": "1.0.0", "installed_localization_english": "1.0.0", "installed_nicknames": "1.0.0", "installed_title_history": "1.22.0",
}
#: What a count of n means. needs: n > 0 passes, else blocks. blocks: n > 0 blocks, else passes. accepts, informs: n > 0 is accepted or told, else passes. always_*: whatever n is.
MODES = {"needs": ("passed", "blocking"), "blocks": ("blocking", "passed"), "accepts": ("accepted_exception", "passed"), "informs": ("informational", "passed"), "always_accepts": ("accepted_exception", "accepted_exception"), "always_informs": ("informational", "informational")}
CLASSES = ("blocking", "accepted_exception", "informational", "passed")
_WIKI = "Promotion requires page URL, revision or permanent-link ID, retrieval time, stated version, and review status."


def _coverage(code: str, page: str, ids: str, what: str) -> list[tuple[str, str, str, str, str | None]]:
    return [
        (f"{'' if code == 'government' else code + '_'}wiki_provenance", "needs", f"Reviewed {page} wiki provenance is recorded", f"Versioned {page} wiki provenance is not loaded", _WIKI),
        (f"{code}_catalog", "blocks", f"{ids} IDs are unresolved", f"Every baseline {ids[0].lower() + ids[1:]} ID resolves", f"{what} coverage is validated by stable-ID joins against the snapshot-scoped installed catalog."),
    ]


# Code, mode, summary where the count is over 0, summary where it is 0, detail (null: made from the counts).
RULES: list[tuple[str, str, str, str, str | None]] = [
    ("build_identity", "needs", "Installed build identity is recorded", "Installed build identity is incomplete", None),
    ("required_parsers", "blocks", "Required parser runs are not current", "All required parser groups have current successful runs", None),
    ("source_manifests", "blocks", "Source manifests are missing or stale", "All source manifests are bound to latest parser runs", None),
    ("selectable_hierarchy", "blocks", "Selectable hierarchy contains warnings", "Every selectable title has a canonical parent chain", "Selectable locations must resolve Barony to County to Duchy to Kingdom to Empire."),
    ("nonselectable_structural_titles", "always_accepts", "Noncanonical titles remain excluded from location selection", "Noncanonical titles remain excluded from location selection", "These installed structural and noble-family records are retained but cannot start a playthrough."),
    ("duplicate_structural_titles", "accepts", "Nonselectable structural capital conflicts remain explicit", "Structural title IDs are unique", "Conflicting noble-family declarations are retained, excluded from selection, and require no inferred winner."),
    ("duplicate_title_history", "blocks", "Baseline-conflicting title histories require review", "Duplicate title histories do not conflict at this baseline", "Only distinct title IDs with conflicting baseline-effective singleton assignments block this date profile."),
    ("opaque_title_history", "blocks", "Baseline-effective title history remains uninterpreted", "Baseline title history is fully interpreted", "Opaque effects and unsupported operations need scope review before promotion."),
    ("character_history_review", "blocks", "Character history requires review", "Character history is fully resolved", None),
    ("holder_lifecycle", "blocks", "Holder lifecycle conflicts remain", "Every title holder is alive at the baseline", "The current conflict is preserved with its title and character IDs in holder validation evidence."),
    ("bookmark_profile", "needs", "Bookmark profile and featured rulers resolve", "Bookmark profile is incomplete", None),
    ("bookmark_dlc_resolution", "blocks", "Bookmark DLC gates are unresolved", "Every bookmark DLC gate resolves to an installed package", None),
    ("capital_resolution", "blocks", "Capital resolution is incomplete", "Static and 867 historical capitals are resolved", "Resolved records retain declared, first-barony-derived, or history-override provenance."),
    ("selectable_localization", "blocks", "Selectable titles are missing English labels", "Every selectable title has an English label", "Nonselectable placeholders do not block location selection."),
    ("nickname_catalog", "blocks", "Nickname catalog or baseline usage is unresolved", "Every baseline-used nickname has valid display provenance", None),
    ("nickname_catalog_orphans", "informs", "Reviewed non-localized nickname definitions are preserved", "Every nickname definition has display provenance", "Reviewed orphans cannot be used by baseline history and expose no invented display label."),
    *_coverage("government", "Government", "Government", "Government"), *_coverage("culture", "Culture", "Culture", "Culture"), *_coverage("faith", "Faith", "Faith", "Faith"),
    *_coverage("dynasty", "Dynasty", "Dynasty", "Dynasty"), *_coverage("house", "House", "Dynasty-house", "House"),
    ("promotion_gate", "always_informs", "Promotion remains an explicit operation", "Promotion remains an explicit operation", None),
]
#: The one nickname that may lack a label.
ORPHAN = "nick_the_bastard_rumoured"


@dataclass
class Evidence:
    """The tables of one baseline and its snapshot.

    baseline (one row): support_status, historical_state_complete, review_status, game_version, steam_build_id. parser_runs: parser_name, parser_run_id, parser_version, status,
    started_at. source_files: source_group, relative_path, sha256, byte_size, modified_at, parser_run_id. titles: title_id, selectable, validation_status, validation_note,
    localization_key. title_blocks: title_id, classification; character_blocks: character_id, classification. title_states: title_id, validation_note, capital_status, government_id.
    character_states: character_id, validation_note, culture_id, faith_id, dynasty_id, dynasty_house_id. holders: title_id, validation_status. bookmark_links: bookmark_id,
    validation_status. bookmark_characters: bookmark_id, character_kind, validation_status. requirements: requirement_value, resolution_status, resolved_package_id. packages: package_id,
    validation_status. labels: localization_key. nicknames: nickname_id, validation_status, localization_language, localization_key, display_name, localization_source_path,
    localization_source_line. used_nicknames: nickname_id. wiki_pages: page_key, canonical_url, permanent_url, revision_id, retrieved_at, stated_game_version, review_status.
    governments, cultures, faiths, dynasties, houses: id, validation_status.
    """

    baseline: DataFrame
    parser_runs: DataFrame
    source_files: DataFrame
    titles: DataFrame
    title_blocks: DataFrame
    character_blocks: DataFrame
    title_states: DataFrame
    character_states: DataFrame
    holders: DataFrame
    bookmark_links: DataFrame
    bookmark_characters: DataFrame
    requirements: DataFrame
    packages: DataFrame
    labels: DataFrame
    nicknames: DataFrame
    used_nicknames: DataFrame
    wiki_pages: DataFrame
    governments: DataFrame
    cultures: DataFrame
    faiths: DataFrame
    dynasties: DataFrame
    houses: DataFrame


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PARSERS.items()), "parser_name string, expected_version string")


def bindings(parser_runs: DataFrame, source_files: DataFrame) -> DataFrame:
    """For each expected parser its latest run, the number of its manifests and their digest, whatever their order.

    The digest is the root of a hash tree over the manifests, so no row holds all of a parser.
    """
    latest = replay.latest(parser_runs, ["parser_name"], [F.desc("started_at"), F.desc("parser_run_id")]).select("parser_name", "parser_run_id", "parser_version", "status")
    held = source_files.select(F.col("source_group").alias("parser_name"), "relative_path", "sha256", "byte_size", "modified_at", "parser_run_id")
    whole = trees.roots(held, ["relative_path"], ["parser_name"], 2).withColumnsRenamed({"sha256": "manifest_digest", "n": "manifest_count"})
    rows = expected(parser_runs.sparkSession).join(latest, "parser_name", "left").join(whole, "parser_name", "left")
    return rows.select("parser_name", "parser_run_id", "parser_version", F.coalesce("status", F.lit("missing")).alias("parser_status"), F.coalesce("manifest_count", F.lit(0)).alias("manifest_count"), F.coalesce("manifest_digest", F.sha2(F.lit(""), 256)).alias("manifest_digest"))


def changed_bindings(stored: DataFrame, current: DataFrame) -> DataFrame:
    """One row: evidence_status and detail. Only parsers that are current are compared; a report without bindings is stale."""
    columns = [c for c in current.columns if c != "parser_name"]
    old = stored.select("parser_name", F.struct(*columns).alias("old"))
    new = current.select("parser_name", F.struct(*columns).alias("new"))
    differ = new.join(old, "parser_name", "left").agg(F.array_sort(F.collect_list(F.when(~F.col("old").eqNullSafe(F.col("new")), F.col("parser_name")))).alias("names"))
    rows = differ.crossJoin(stored.agg(F.count("*").alias("held")))  # one row each
    none, moved = F.col("held") == 0, F.size("names") > 0
    detail = F.when(none, "Legacy report has no parser-run or manifest bindings.").when(moved, F.concat(F.lit("Evidence changed for: "), F.array_join("names", ", "), F.lit("."))).otherwise("Report evidence matches the current parser runs and manifests.")
    return rows.select(F.when(none | moved, "stale").otherwise("current").alias("evidence_status"), detail.alias("evidence_detail"))


def _row(frame: DataFrame, code: str, n: Column, shown: Column | None = None, detail: Column | None = None) -> DataFrame:
    """One row of a one-row frame: the count that classifies, the count that is shown, the detail."""
    return frame.select(F.lit(code).alias("code"), n.cast("long").alias("n"), (n if shown is None else shown).cast("long").alias("shown"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _unresolved(used: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """How many distinct ids the valid rows of a catalog lack, as `unresolved` of one row."""
    ids = used.select(F.col(column).alias("id")).where("id is not null").distinct()
    return ids.join(catalog.where("validation_status = 'valid'").select("id"), "id", "left_anti").agg(F.count("*").alias("unresolved"))


def parser_findings(bound: DataFrame, source_files: DataFrame) -> list[DataFrame]:
    """Rows of required_parsers and source_manifests."""
    rows = bound.join(expected(bound.sparkSession), "parser_name")
    name, run = F.col("parser_name"), F.col("parser_run_id")
    wrong = (
        F.when(run.isNull(), F.concat(name, F.lit(": missing"))).when(F.col("parser_status") != "completed", F.concat(name, F.lit(": latest status "), "parser_status"))
        .when(F.col("parser_version") != F.col("expected_version"), F.concat(name, F.lit(": expected "), "expected_version", F.lit(", latest "), "parser_version"))
    )
    runs = rows.agg(F.array_sort(F.collect_list(wrong)).alias("bad"), F.count("*").alias("all"), F.array_sort(F.collect_list(F.concat(name, F.lit("@"), "expected_version"))).alias("good"))
    bad = F.size("bad") > 0
    out = [_row(runs, "required_parsers", F.size("bad"), F.when(bad, F.size("bad")).otherwise(F.col("all")), F.when(bad, F.array_join("bad", "; ")).otherwise(F.array_join("good", ", ")))]
    held = source_files.groupBy(F.col("source_group").alias("parser_name"), F.col("parser_run_id").alias("of_run")).agg(F.count("*").alias("n"))
    each = rows.select("parser_name", "parser_run_id").join(held, "parser_name", "left").groupBy("parser_name", "parser_run_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("of_run") == run, F.col("n"))), F.lit(0)).alias("bound"))
    lacking = (
        F.when(F.col("total") == 0, F.concat(name, F.lit(": missing"))).when(run.isNull(), F.concat(name, F.lit(": no latest parser run")))
        .when(F.col("bound") != F.col("total"), F.concat(name, F.lit(": "), F.col("bound"), F.lit(" of "), F.col("total"), F.lit(" bound to latest run")))
    )
    files = each.agg(F.array_sort(F.collect_list(lacking)).alias("bad"), F.sum("total").alias("total"), F.array_sort(F.collect_list(F.concat(name, F.lit(": "), F.col("total")))).alias("good"))
    out.append(_row(files, "source_manifests", F.size("bad"), F.when(bad, F.size("bad")).otherwise(F.col("total")), F.when(bad, F.array_join("bad", "; ")).otherwise(F.array_join("good", ", "))))
    return out


def nickname_findings(e: Evidence) -> list[DataFrame]:
    """Rows of nickname_catalog and nickname_catalog_orphans."""
    labelled = F.coalesce(*[F.col(c).cast("string") for c in ("localization_language", "localization_key", "display_name", "localization_source_path", "localization_source_line")]).isNotNull()
    orphan = F.col("validation_status") == "reviewed_orphan"
    invalid = ~F.col("validation_status").isin("valid", "reviewed_orphan") | (orphan & ((F.col("nickname_id") != ORPHAN) | labelled))
    catalog = e.nicknames.agg(F.count_if(invalid).alias("invalid"), F.count("*").alias("all"), F.count_if(orphan).alias("orphans"))
    good = e.nicknames.where("validation_status = 'valid' and localization_language = 'english' and localization_key = nickname_id and display_name is not null and localization_source_path is not null and localization_source_line is not null")
    used = e.used_nicknames.select("nickname_id").distinct().join(good.select("nickname_id", F.lit(True).alias("good")).distinct(), "nickname_id", "left")
    asked = used.agg(F.count("*").alias("used"), F.array_sort(F.collect_list(F.when(F.col("good").isNull(), F.col("nickname_id")))).alias("lacking"))
    both = catalog.crossJoin(asked)  # one row each
    n = F.col("invalid") + F.size("lacking") + (F.col("all") == 0).cast("int")
    detail = F.when(F.size("lacking") > 0, F.array_join("lacking", ", ")).when(F.col("all") > 0, F.concat(F.col("used"), F.lit(" baseline-used stable IDs resolve to valid English catalog rows."))).otherwise("Nickname catalog is not loaded.")
    return [_row(both, "nickname_catalog", n, F.when(n > 0, n).otherwise(F.col("used")), detail), _row(both, "nickname_catalog_orphans", F.col("orphans"))]


def findings(e: Evidence) -> DataFrame:
    """(finding_order, code, classification, subject_count, summary, detail), a row for each rule."""
    spark = e.baseline.sparkSession
    named = F.coalesce(F.col("game_version") != "", F.lit(False)) & F.coalesce(F.col("steam_build_id") != "", F.lit(False))
    shown = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in ("game_version", "steam_build_id")]
    rows = [_row(e.baseline, "build_identity", named.cast("int"), None, F.concat(F.lit("Game "), shown[0], F.lit(", Steam build "), shown[1], F.lit(".")))]
    rows += parser_findings(bindings(e.parser_runs, e.source_files), e.source_files)
    titles = e.titles.agg(
        F.count_if(F.col("selectable") & (F.col("validation_status") == "warning")).alias("a"), F.count_if(~F.col("selectable") & F.col("validation_note").startswith("non-canonical rank chain:")).alias("b"),
        F.count_if(F.col("validation_note") == "duplicate title declarations").alias("c"),
    )
    rows += [_row(titles, "selectable_hierarchy", F.col("a")), _row(titles, "nonselectable_structural_titles", F.col("b")), _row(titles, "duplicate_structural_titles", F.col("c"))]
    clash = F.col("classification") == "conflicting_at_baseline"
    rows.append(_row(e.title_blocks.agg(F.count_distinct(F.when(clash, F.col("title_id"))).alias("n")), "duplicate_title_history", F.col("n")))
    opaque = F.col("validation_note").contains("not evaluated:")
    states = e.title_states.agg(F.count_if(opaque).alias("a"), F.count_if(F.col("capital_status").isin("unresolved", "not_evaluated")).alias("b"))
    rows.append(_row(states, "opaque_title_history", F.col("a")))
    people = e.character_blocks.agg(F.count_distinct(F.when(clash, F.col("character_id"))).alias("d")).crossJoin(e.character_states.agg(F.count_if(opaque).alias("o")))  # one row each
    rows.append(_row(people, "character_history_review", F.col("d") + F.col("o"), None, F.concat(F.col("d"), F.lit(" duplicate IDs and "), F.col("o"), F.lit(" baseline-effective opaque states."))))
    rows.append(_row(e.holders.agg(F.count_if(F.col("validation_status") == "warning").alias("n")), "holder_lifecycle", F.col("n")))
    of_baseline = e.bookmark_links.select("bookmark_id").distinct()
    featured = e.bookmark_characters.where("character_kind = 'featured' and validation_status = 'warning'").join(of_baseline, "bookmark_id", "left_semi").agg(F.count("*").alias("w"))
    marks = e.bookmark_links.agg(F.count_if(F.col("validation_status") == "valid").alias("l")).crossJoin(featured)  # one row each
    rows.append(_row(marks, "bookmark_profile", F.when(F.col("w") == 0, F.col("l")).otherwise(0), F.col("l"), F.concat(F.col("l"), F.lit(" themed collections; "), F.col("w"), F.lit(" unresolved direct featured rulers."))))
    valid = e.packages.where("validation_status = 'valid'").select(F.col("package_id").alias("resolved_package_id"), F.lit(True).alias("there")).distinct()
    gates = e.requirements.join(valid, "resolved_package_id", "left")
    open_gate = (F.col("resolution_status") != "resolved") | F.col("there").isNull()
    gated = gates.agg(F.array_sort(F.collect_set(F.when(open_gate, F.col("requirement_value")))).alias("bad"), F.count_if((F.col("resolution_status") == "resolved") & F.col("resolved_package_id").isNotNull()).alias("ok"))
    bad = F.size("bad") > 0
    rows.append(_row(gated, "bookmark_dlc_resolution", F.size("bad"), F.when(bad, F.size("bad")).otherwise(F.col("ok")), F.when(bad, F.array_join("bad", ", ")).otherwise(F.concat(F.col("ok"), F.lit(" package-gated bookmark requirements; ungated bookmarks are core game.")))))
    rows.append(_row(states, "capital_resolution", F.col("b")))
    unlabelled = e.titles.where("selectable").join(e.labels.select("localization_key").distinct(), "localization_key", "left_anti").agg(F.count("*").alias("n"))
    rows.append(_row(unlabelled, "selectable_localization", F.col("n")))
    rows += nickname_findings(e)
    known = (F.col("canonical_url") != "") & (F.col("permanent_url") != "") & (F.col("revision_id") != "") & F.col("retrieved_at").isNotNull() & F.col("stated_game_version").isNotNull() & (F.col("review_status") == "reviewed")
    wiki = e.wiki_pages.agg(*[F.count_if(known & (F.col("page_key") == page)).alias(page) for page in ("government", "culture", "faith", "dynasty", "house")])
    for page, used, column, catalog in (
        ("government", e.title_states, "government_id", e.governments), ("culture", e.character_states, "culture_id", e.cultures), ("faith", e.character_states, "faith_id", e.faiths),
        ("dynasty", e.character_states, "dynasty_id", e.dynasties), ("house", e.character_states, "dynasty_house_id", e.houses),
    ):
        rows.append(_row(wiki, "wiki_provenance" if page == "government" else f"{page}_wiki_provenance", F.col(page)))
        rows.append(_row(_unresolved(used, column, catalog), f"{page}_catalog", F.col("unresolved")))
    told = F.concat(F.lit("Current statuses: snapshot="), "review_status", F.lit(", baseline="), "support_status", F.lit(", historical_state_complete="), F.lower(F.col("historical_state_complete").cast("string")), F.lit("."))
    rows.append(_row(e.baseline, "promotion_gate", F.lit(0), None, told))
    registry = spark.createDataFrame([(k, code, *MODES[mode], some, none, detail) for k, (code, mode, some, none, detail) in enumerate(RULES, 1)], "finding_order int, code string, some string, none string, some_summary string, none_summary string, fixed string")
    positive = F.col("n") > 0
    return reduce(DataFrame.unionByName, rows).join(F.broadcast(registry), "code").select(
        "finding_order", "code", F.when(positive, F.col("some")).otherwise(F.col("none")).alias("classification"), F.col("shown").alias("subject_count"),
        F.when(positive, F.col("some_summary")).otherwise(F.col("none_summary")).alias("summary"), F.coalesce("detail", "fixed").alias("detail"),
    )


def tallies(found: DataFrame, key: str | None = None) -> DataFrame:
    """How many findings of each class, and the overall status; of each report if a key is given."""
    grouped = found.groupBy(key) if key else found.groupBy()
    counts = grouped.agg(*[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES])
    return counts.withColumn("overall_status", F.when(F.col("blocking") > 0, "blocked").otherwise("ready_for_review"))


def latest_report(reports: DataFrame, found: DataFrame, stored: DataFrame, current: DataFrame, baseline_id: str) -> DataFrame:
    """One row of a baseline's newest report: ids, status, evidence status, number of bindings, counts and findings in order; none if there is no report.

    reports: report_id, baseline_id, generated_at; found: report_id and findings; stored: report_id and bindings; current: bindings.
    """
    newest = reports.where(F.col("baseline_id") == baseline_id).orderBy(F.desc("generated_at"), F.desc("report_id")).limit(1)
    bound = stored.join(newest.select("report_id"), "report_id", "left_semi")
    told = found.join(newest.select("report_id"), "report_id", "left_semi")
    # A report has one finding a rule and one binding a parser, so these lists are bounded by the registry.
    listed = told.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("finding_order", "code", "classification", "subject_count", "summary", "detail"))).alias("findings"))
    status = changed_bindings(bound.drop("report_id"), current).crossJoin(bound.agg(F.count("*").alias("evidence_binding_count")))  # one row each
    return newest.select("report_id", "generated_at").join(tallies(told, "report_id"), "report_id").join(listed, "report_id").crossJoin(status)
