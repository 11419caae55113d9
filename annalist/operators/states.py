"""Replay of titles and characters up to a baseline date, with the status of every field, and checks of holders.

Dates are y*10000 + m*100 + d numbers. Every state is one grouped aggregate over operations; what is joined has one row an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import classify

CLEAR = "0"
# Keys that titles and characters are replayed from.
HOLDER_KEYS = ("holder", "holder_ignore_head_of_faith_requirement")
TITLE_KEYS = (*HOLDER_KEYS, "liege", "government", "change_development_level")
IDENTITY_KEYS = ("name", "female", "culture", "religion", "faith", "dynasty", "dynasty_house")


def whole_number(text: Column) -> Column:
    """A number as Python's int() reads it: spaces around, a sign, and single underscores between digits."""
    return F.when(text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(text, r"[\s_]", "")).cast("bigint")


def date_text(key: Column) -> Column:
    return F.when(key.isNotNull(), F.format_string("%04d-%02d-%02d", F.floor(key / 10000).cast("int"), (F.floor(key / 100) % 100).cast("int"), (key % 100).cast("int")))


def _last(when: Column, what: Column, order: Column) -> Column:
    return F.max_by(F.when(when, what), F.when(when, order))


def title_states(titles: DataFrame, operations: DataFrame, capitals: DataFrame, classes: DataFrame, cutoff: int) -> DataFrame:
    """One row a title: holder, liege, government, development and capital, each with its status, and what could not be evaluated.

    titles: title_id, capital_id, capital_status (the static ones). operations: title_id, effective_date, declaration_order, operation_key,
    scalar_value, evaluated (whether a recogniser says all that it does). capitals: title_id (the owner), capital_id, event_type,
    effective_date, declaration_order, step, required_date, valid. classes: as classify.title_classes gives them.
    """
    key, value, order = F.col("operation_key"), F.col("scalar_value"), F.struct("effective_date", "declaration_order")
    number = whole_number(value)
    says = value.isNotNull()
    holder = key.isin(*HOLDER_KEYS) & says
    read = holder | (key.isin("liege", "government") & says) | ((key == "change_development_level") & number.isNotNull())
    now = operations.where(F.col("effective_date") <= cutoff).groupBy("title_id").agg(
        _last(holder, F.struct(value.alias("value"), key.alias("key")), order).alias("h"),
        _last((key == "liege") & says, value, order).alias("l"), _last((key == "government") & says, value, order).alias("government"),
        F.sum(F.when(key == "change_development_level", number)).alias("development"),
        F.array_sort(F.collect_set(F.when(~read & ((key == "change_development_level") | ~F.col("evaluated")), key))).alias("unknown"),
    )
    due = capitals.where(F.col("valid") & (F.col("effective_date") <= cutoff) & (F.col("required_date").isNull() | (F.col("required_date") == cutoff)))
    moved = due.groupBy("title_id").agg(F.max_by(F.struct("capital_id", "event_type"), F.struct("effective_date", "declaration_order", "step")).alias("c"))
    clash = F.coalesce(F.col("classification") == "conflicting_at_baseline", F.lit(False))

    def ambiguous(field: str) -> Column:
        return clash & F.array_contains("conflict_fields", field)

    def field(name: str, current: Column, status: Column) -> list[Column]:
        return [F.when(~ambiguous(name), current).alias(name), F.when(ambiguous(name), "ambiguous_duplicate").otherwise(status).alias(f"{name}_status")]

    h, liege = F.col("h.value"), F.col("l")
    holder_status = F.when(h.isNull(), "no_declaration").when(h == CLEAR, "explicit_unheld").when(F.col("h.key") == HOLDER_KEYS[1], "declared_ignore_head_of_faith_requirement").otherwise("declared")
    liege_status = F.when(liege.isNull(), "no_declaration").when(liege == CLEAR, "explicit_independent").otherwise("declared")
    note = F.concat_ws(
        "; ", F.when(F.size("unknown") > 0, F.concat(F.lit("not evaluated: "), F.array_join("unknown", ", "))),
        F.when(clash, F.concat(F.lit("baseline-conflicting duplicate title declarations: "), F.array_join("conflict_fields", ", "))),
    )
    rows = titles.join(now, "title_id", "left").join(moved, "title_id", "left").join(classes.select("title_id", "classification", "conflict_fields"), "title_id", "left")
    return rows.select(
        "title_id", *field("holder", F.nullif(h, F.lit(CLEAR)), holder_status), *field("liege", F.nullif(liege, F.lit(CLEAR)), liege_status),
        *field("government", F.col("government"), F.when(F.col("government").isNull(), "no_declaration").otherwise("declared")),
        "development", F.when(F.col("development").isNull(), "no_declaration").otherwise("derived").alias("development_status"),
        F.coalesce("c.capital_id", "capital_id").alias("capital"), F.coalesce(F.concat(F.lit("history_"), "c.event_type"), "capital_status", F.lit("no_declaration")).alias("capital_status"),
        F.when(note == "", "valid").otherwise("warning").alias("validation_status"), F.nullif(note, F.lit("")).alias("validation_note"),
    )


def character_states(operations: DataFrame, classes: DataFrame, cutoff: int) -> DataFrame:
    """One row a character: identity, life and what could not be evaluated. Birth and death count whatever their date.

    operations: character_id, effective_date (null: undated), declaration_order, operation_key, scalar_value, set_culture (the last valid
    culture that an effect's body sets), evaluated. classes: as classify.character_classes gives them; settled_operations come first.
    """
    key, value, date, order = F.col("operation_key"), F.col("scalar_value"), F.col("effective_date"), classify.character_order()
    now = date.isNull() | (date <= cutoff)
    says, effect = value.isNotNull() & now, (key == "effect") & date.isNotNull()

    def last(keys: tuple[str, ...]) -> Column:
        return _last(key.isin(*keys) & says, value, order)

    culture = ((key == "culture") & says) | (effect & now & F.col("set_culture").isNotNull())
    found = operations.groupBy("character_id").agg(
        last(("name",)).alias("name"), last(("female",)).alias("female"), _last(culture, F.when(effect, F.col("set_culture")).otherwise(value), order).alias("culture"),
        _last(key.isin("religion", "faith") & says, F.struct(value.alias("value"), key.alias("key")), order).alias("f"), last(("dynasty",)).alias("dynasty"), last(("dynasty_house",)).alias("dynasty_house"),
        _last((key == "birth") & date.isNotNull(), date, order).alias("birth"), _last((key == "death") & date.isNotNull(), date, order).alias("death"),
        F.coalesce(F.max(effect & now & ~F.col("evaluated")), F.lit(False)).alias("opaque"),
    )
    rows = found.join(classes.select("character_id", "classification", "conflict_fields"), "character_id", "left")

    def clear(name: str) -> Column:
        return F.coalesce(F.array_contains("conflict_fields", name), F.lit(False))

    def kept(name: str, what: Column) -> Column:
        return F.when(~clear(name), what)

    life = F.when(F.col("birth").isNull(), "unknown_birth").when(F.col("birth") > cutoff, "not_born_at_baseline").when(F.col("death") <= cutoff, "dead_at_baseline").otherwise("alive_at_baseline")
    sex = F.when(clear("sex"), "unknown").when(F.col("female") == "yes", "female").otherwise("male")
    sex_status = F.when(clear("sex"), "ambiguous_duplicate").when(F.col("female").isNull(), "inferred_default").otherwise("declared")
    note = F.concat_ws(
        "; ", F.when(F.col("classification") == "conflicting_at_baseline", F.concat(F.lit("baseline-conflicting duplicate character declarations: "), F.array_join("conflict_fields", ", "))),
        F.when(F.col("opaque"), F.lit("not evaluated: effect")),
    )
    return rows.select(
        "character_id", kept("display_name", F.col("name")).alias("display_name"), sex.alias("sex"), sex_status.alias("sex_status"), kept("culture_id", F.col("culture")).alias("culture_id"),
        kept("faith_id", F.col("f.value")).alias("faith_id"), kept("faith_id", F.col("f.key")).alias("faith_source_key"), kept("dynasty_id", F.col("dynasty")).alias("dynasty_id"),
        kept("dynasty_house_id", F.col("dynasty_house")).alias("dynasty_house_id"), kept("birth_date", date_text(F.col("birth"))).alias("birth_date"), kept("death_date", date_text(F.col("death"))).alias("death_date"),
        life.alias("lifecycle_status"), F.when(note == "", "valid").otherwise("warning").alias("validation_status"), F.nullif(note, F.lit("")).alias("validation_note"),
    )


def lifecycle_events(operations: DataFrame) -> DataFrame:
    """Dated births and deaths; a date inside one that isn't the date around it is a warning."""
    rows = operations.where(F.col("operation_key").isin("birth", "death") & F.col("effective_date").isNotNull())
    part = [F.regexp_extract("scalar_value", r"^(\d+)\.(\d+)\.(\d+)$", k) for k in (1, 2, 3)]
    inner = F.when(part[0] != "", part[0].cast("int") * 10000 + part[1].cast("int") * 100 + part[2].cast("int"))
    differs = F.coalesce(inner != F.col("effective_date"), F.lit(False))
    return rows.select(
        "character_id", date_text(F.col("effective_date")).alias("effective_date"), F.col("operation_key").alias("event_type"), F.col("scalar_value").alias("text_value"), "declaration_order",
        F.when(differs, "warning").otherwise("valid").alias("validation_status"), F.when(differs, "embedded lifecycle date differs from enclosing date").alias("validation_note"),
    )


def native_languages(states: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(character_id, language_id) by each one's culture, and the cultures that no mapping has, which are to stop a load. mapping: culture_id, language_id."""
    # Cultures are a small dimension, but their number isn't bounded here; AQE broadcasts them if they are small.
    held = states.where("culture_id is not null").join(mapping, "culture_id", "left")
    lacking = held.where("language_id is null").select(F.lit("culture without a native language").alias("rule"), F.col("culture_id").alias("subject")).distinct()
    return held.where("language_id is not null").select("character_id", "language_id"), lacking


def history_languages(events: DataFrame, mapping: DataFrame, known: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """First grants of languages that aren't known already, and cultures without a mapping. events: character_id, culture_id, effective_date, declaration_order, step; known: character_id, language_id."""
    due = events.where(F.col("effective_date") <= cutoff).join(mapping, "culture_id", "left")
    lacking = due.where("language_id is null").select(F.lit("unresolved culture of a language").alias("rule"), F.col("culture_id").alias("subject")).distinct()
    new = due.where("language_id is not null").join(known, ["character_id", "language_id"], "left_anti")
    first = new.groupBy("character_id", "language_id").agg(F.min(F.struct("effective_date", "declaration_order", "step")).alias("at"))
    return first.select("character_id", "language_id", "at.effective_date", "at.declaration_order"), lacking


def nickname_states(events: DataFrame, catalog: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """The latest nickname event of each character (a clear has a null id), and used ids that the catalog lacks. events: character_id, nickname_id, effective_date, declaration_order, step; catalog: nickname_id."""
    lacking = events.where("nickname_id is not null").join(catalog, "nickname_id", "left_anti").select(F.lit("nickname without a valid row").alias("rule"), F.col("nickname_id").alias("subject")).distinct()
    last = F.max_by(F.struct("nickname_id", "effective_date", "declaration_order", "step"), F.struct("effective_date", "declaration_order", "step"))
    now = events.where(F.col("effective_date") <= cutoff).groupBy("character_id").agg(last.alias("x"))
    return now.select("character_id", "x.nickname_id", F.when(F.col("x.nickname_id").isNull(), "clear").otherwise("set").alias("event_kind"), "x.effective_date", "x.declaration_order"), lacking


def holder_validations(holders: DataFrame, states: DataFrame, duplicates: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Whether each title's holder is declared, unique and alive. holders: title_id, holder_id; states: character_id, lifecycle_status;
    duplicates: character_id; adjudications: title_id, declared_id, resolved_id, review_note, which overrule the holder they were made for."""
    ruled = holders.join(adjudications, "title_id", "left").withColumn("current", F.coalesce(F.col("declared_id") == F.col("holder_id"), F.lit(False)))
    named = ruled.withColumn("character_id", F.when(F.col("current"), F.col("resolved_id")).otherwise(F.col("holder_id")))
    rows = named.join(states.select("character_id", "lifecycle_status"), "character_id", "left").join(duplicates.select("character_id", F.lit(True).alias("twice")).distinct(), "character_id", "left")
    current, twice, life = F.col("current"), F.col("twice").isNotNull(), F.coalesce("lifecycle_status", F.lit("unknown"))
    declared = F.when(current, "runtime_adjudicated").when(F.col("lifecycle_status").isNull(), "missing").otherwise("found")
    alive = life == "alive_at_baseline"
    note = F.concat_ws(
        "; ", F.when(current, F.concat("review_note", F.lit("; installed declaration retained as "), "holder_id")).when(F.col("declared_id").isNotNull(), "runtime adjudication does not match the current installed declaration"),
        F.when(declared == "missing", "holder has no character declaration"), F.when(twice, "holder character has duplicate declarations"), F.when(~alive, F.concat(F.lit("holder lifecycle is "), life)),
    )
    return rows.select(
        "title_id", F.col("character_id").alias("holder_character_id"), declared.alias("declaration_status"), F.when(twice, "duplicate").otherwise("unique").alias("uniqueness_status"), life.alias("lifecycle_status"),
        F.when((declared != "missing") & ~twice & alive, "valid").otherwise("warning").alias("validation_status"), F.nullif(note, F.lit("")).alias("validation_note"),
    )


def save_adjudications(requests: DataFrame, titles: DataFrame, states: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Requests to overrule a holder by a save, each with the reasons that refuse it ('' if none) and the declared holder.

    requests: title_id, resolved_id, primary_title_id, domain array<string>, save_date, save_version, baseline_date, baseline_version, promoted.
    """
    held = titles.select("title_id", F.col("holder_id").alias("declared_id"))
    primary = titles.select(F.col("title_id").alias("primary_title_id"), F.col("holder_id").alias("primary_holder"))
    life = states.select(F.col("character_id").alias("resolved_id"), "lifecycle_status")
    twice = duplicates.select(F.col("character_id").alias("resolved_id"), F.lit(True).alias("twice")).distinct()
    rows = requests.join(held, "title_id", "left").join(primary, "primary_title_id", "left").join(life, "resolved_id", "left").join(twice, "resolved_id", "left")
    reasons = F.concat_ws(
        "; ", F.when(F.col("promoted"), "Promoted reference evidence cannot be adjudicated"), F.when(F.col("save_date") != F.col("baseline_date"), "Save date does not match baseline date"),
        F.when(F.col("save_version") != F.col("baseline_version"), "Save version does not match"), F.when(~F.array_contains("domain", F.col("title_id")), "Observed title is not in the player's saved domain"),
        F.when(F.col("declared_id").isNull(), "Title lacks an installed holder declaration"),
        F.when(~F.coalesce(F.col("primary_holder") == F.col("resolved_id"), F.lit(False)), "Resolved character does not match the installed holder of the saved primary title"),
        F.when(~F.coalesce(F.col("lifecycle_status") == "alive_at_baseline", F.lit(False)) | F.col("twice").isNotNull(), "Resolved character is not unique and alive at the baseline"),
    )
    return rows.select("title_id", "declared_id", "resolved_id", reasons.alias("reasons"))


def contract_states(events: DataFrame, cutoff: int) -> DataFrame:
    """The latest contract of each subject and type up to a date. events: subject_id, contract_type_id, effective_date, declaration_order, level_index, obligation_id, liege_id."""
    order = F.struct("effective_date", "declaration_order")
    last = F.max_by(F.struct("obligation_id", "level_index", "liege_id", "effective_date", "declaration_order"), order)
    return events.where(F.col("effective_date") <= cutoff).groupBy("subject_id", "contract_type_id").agg(last.alias("x")).select("subject_id", "contract_type_id", "x.*")


def contract_problems(writes: DataFrame, reviewed: DataFrame, catalog: DataFrame, states: DataFrame, lieges: DataFrame) -> DataFrame:
    """What stops a load of reviewed contracts: the set must be the reviewed one, bodies unchanged, obligations installed, subjects and their one liege as expected.

    writes: subject_id, effective_date, source_path, contract_type_id, level_index (null: reviewed as inactive); reviewed: the same and liege_id;
    catalog: contract_type_id, level_index; states: character_id; lieges: subject_id, liege_id, all that hold a title above one of the subject's.
    """
    key = ["subject_id", "effective_date", "source_path"]
    named = F.concat_ws("|", *key)
    said = writes.select(*key, F.struct("contract_type_id", "level_index").alias("said"), F.lit(True).alias("is_said"))
    both = reviewed.withColumn("wanted", F.struct("contract_type_id", "level_index")).join(said, key, "full_outer")
    changed = F.when(F.col("is_said").isNull() | F.col("wanted").isNull(), "reviewed contract set changed").when(~F.col("said").eqNullSafe(F.col("wanted")), "reviewed contract body changed")
    out = both.select(changed.alias("rule"), named.alias("subject")).where("rule is not null")
    active = reviewed.where("contract_type_id is not null").join(writes.select(*key), key, "left_semi")
    out = out.unionByName(active.join(catalog, ["contract_type_id", "level_index"], "left_anti").select(F.lit("obligation isn't installed").alias("rule"), named.alias("subject")))
    out = out.unionByName(active.join(states, active["subject_id"] == states["character_id"], "left_anti").select(F.lit("subject lacks a state").alias("rule"), named.alias("subject")))
    held = lieges.groupBy("subject_id").agg(F.count_distinct("liege_id").alias("n"), F.min("liege_id").alias("found"))
    wrong = active.join(held, "subject_id", "left").where("n is null or n <> 1 or found <> liege_id")
    return out.unionByName(wrong.select(F.lit("liege changed").alias("rule"), named.alias("subject")))


def running(operations: DataFrame, value: Column, inclusive: bool = False) -> Column:
    """The last non-null value of a title's operations before the row, or up to it."""
    frame = Window.partitionBy("title_id").orderBy("effective_date", "declaration_order").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.last(value, ignorenulls=True).over(frame)
