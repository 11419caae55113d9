"""Title operations to typed events, and the projections that depend on who held the title when an effect ran.

Recognisers say what a body's form means (`effects`, `forms`). Whether that holds is said here by joins with what is installed and by the
values in force just before the operation (one window over a title's operations). Of several readings of an operation the first in
ORDER counts; a court assignment that is not all that a body says leaves the rest to the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import effects, forms, readings
from annalist.operators import folds, states
from annalist.session import written

#: Readings by precedence.
ORDER = ("court", "special_title", "state_faith", "prestige", "ceremonial_title", "adventurer", "capital", "added_law", "eastern_noop", "landless_noop", "fallback", "laws", "de_jure", "tributary", "name", "plain")
ADVENTURER_LAW = "landless_adventurer_succession_law"
_KEY = ["title_id", "effective_date", "declaration_order"]
EVENT = "title_id string, effective_date int, declaration_order long, reading string, step int, owner_id string, event_type string, text_value string, integer_value bigint, validation_status string, validation_note string, required_date int, complete boolean"


@dataclass
class Installed:
    """What a snapshot holds: ids of laws, contract groups, languages and faiths (id), titles (title_id, title_rank, parent_title_id),
    labels (localization_key, display_name, aliases followed), dynasties (character_id, dynasty_id), known languages (character_id,
    language_id), and the package of each feature flag."""

    titles: DataFrame
    laws: DataFrame
    groups: DataFrame
    languages: DataFrame
    faiths: DataFrame
    labels: DataFrame
    dynasties: DataFrame
    known: DataFrame
    packages: dict[str, str] = field(default_factory=dict)


def _has(rows: DataFrame, column: str, ids: DataFrame, key: str, mark: str) -> DataFrame:
    """rows with a flag: whether the column's value is among the ids."""
    named = ids.select(F.col(key).alias("_id")).distinct().withColumn(mark, F.lit(True))
    return rows.join(named, rows[column] == named["_id"], "left").drop("_id").withColumn(mark, F.coalesce(mark, F.lit(False)))


@dataclass
class Read:
    """Operations whose bodies were parsed once. forms: effects of reviewed form (_KEY, form, value, required_date, complete) with the holder, plain holder,
    government and laws in force; said: what bodies say (_KEY, operation_key, kind, owner, value, second, required_date, step, complete)."""

    operations: DataFrame
    forms: DataFrame
    said: DataFrame


def read(operations: DataFrame) -> Read:
    """One parse, one dealing by title, and one table in the shared folder that all readings are taken from."""
    key, value = F.col("operation_key"), F.col("scalar_value")
    held = readings.read(operations)
    ids = F.filter(F.split(F.regexp_replace("raw_value", r"^\{|\}$", " "), r"\s+"), lambda x: x != "")
    legal = (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda x: x.rlike(r"^[A-Za-z0-9_-]+$"))
    laws = F.when((key == "succession_laws") & (F.col("value_kind") == "block") & legal, ids)
    rows = held.select(
        *operations.columns, "readings", F.nullif(states.running(held, F.when(key.isin(*states.HOLDER_KEYS), value)), F.lit("0")).alias("holder"), F.nullif(states.running(held, F.when(key == "holder", value), True), F.lit("0")).alias("plain_holder"),
        states.running(held, F.when(key == "government", F.coalesce(value, F.lit("")))).alias("government"), states.running(held, laws, True).alias("laws"),
    )
    table = written(operations.sparkSession, rows, "title-operations")
    each = table.select(*_KEY, "operation_key", "holder", "plain_holder", "government", "laws", F.explode("readings").alias("r"))
    found = each.where("r.origin = 'form'").select(*_KEY, F.col("r.name").alias("form"), "r.value", "r.required_date", "r.complete", "holder", "plain_holder", "government", "laws")
    said = each.where("r.origin = 'said'").select(*_KEY, "operation_key", F.col("r.name").alias("kind"), "r.owner", "r.value", "r.second", "r.required_date", "r.step", "r.complete")
    return Read(table.select(*operations.columns), found, said)


def court_assignments(effects_in_force: DataFrame, installed: Installed, cutoff: int) -> DataFrame:
    """Court languages and types set for the holder of that time: _KEY, character_id, field, value, learned (null: no learning), complete."""
    if forms.COURT not in installed.packages:
        return effects_in_force.sparkSession.createDataFrame([], "title_id string, effective_date int, declaration_order long, character_id string, field string, value string, learned boolean, complete boolean")
    rows = effects_in_force.where(F.col("form").startswith("court_") & F.col("holder").isNotNull() & (F.col("effective_date") <= cutoff))
    known = _has(rows, "value", installed.languages, "id", "spoken").where((F.col("form") == "court_type") | F.col("spoken"))
    learns = (F.col("form") == "court_language_learned") & F.col("complete")
    first = F.row_number().over(Window.partitionBy("holder", "value", "learns").orderBy("effective_date", "declaration_order")) == 1
    native = installed.known.select(F.col("character_id").alias("holder"), F.col("language_id").alias("value"), F.lit(True).alias("native")).distinct()
    told = known.withColumn("learns", learns).join(native, ["holder", "value"], "left").withColumn("new", first & F.col("native").isNull())
    name = F.when(F.col("form") == "court_type", "court_type").otherwise("court_language")
    whole = F.col("complete") & (F.col("form").isin("court_language", "court_type") | F.col("learns"))
    return told.select(*_KEY, F.col("holder").alias("character_id"), name.alias("field"), "value", F.when(F.col("learns"), F.col("new")).alias("learned"), whole.alias("complete"))


def court_states(assignments: DataFrame) -> DataFrame:
    """The last language and type of each character's court."""
    order = F.struct("effective_date", "declaration_order")

    def last(name: str) -> list[Column]:
        mine = F.col("field") == name
        pick = F.max_by(F.when(mine, F.struct("value", "effective_date", "declaration_order")), F.when(mine, order))
        return [pick["value"].alias(f"{name}_id"), pick["effective_date"].alias(f"{name}_date"), pick["declaration_order"].alias(f"{name}_order")]

    return assignments.groupBy("character_id").agg(*last("court_language"), *last("court_type"))


def state_faiths(effects_in_force: DataFrame, assignments: DataFrame, installed: Installed, cutoff: int) -> DataFrame:
    """Administrative state faiths whose body, holder, government and court assignment are the certified ones: _KEY, faith_id, character_id."""
    if forms.COURT not in installed.packages or forms.LANDLESS not in installed.packages:
        return effects_in_force.where("false").select(*_KEY, F.col("value").alias("faith_id"), F.col("holder").alias("character_id"))
    rows = effects_in_force.where((F.col("form") == "state_faith") & (F.col("government") == "administrative_government") & (F.col("effective_date") <= cutoff))
    held = _has(_has(rows, "value", installed.faiths, "id", "faith_known"), "title_id", installed.titles, "title_id", "title_known").where("faith_known and title_known")
    court = assignments.where("field = 'court_type' and value = 'court_intrigue'").select(*_KEY, F.col("character_id").alias("holder"))
    return held.join(court, [*_KEY, "holder"], "left_semi").select(*_KEY, F.col("value").alias("faith_id"), F.col("holder").alias("character_id"))


def prestige_bounds(effects_in_force: DataFrame, installed: Installed, cutoff: int, helper_reviewed: bool = True) -> DataFrame:
    """Lower bounds of dynasty prestige: 5 by the reviewed helper, 9 by the direct body, for the dynasty of the holder of that time."""
    wanted = ["prestige_direct", *(["prestige_helper"] if helper_reviewed else [])]
    rows = effects_in_force.where(F.col("form").isin(*wanted) & (F.col("effective_date") <= cutoff))
    of = installed.dynasties.select(F.col("character_id").alias("holder"), "dynasty_id")
    level = F.when(F.col("form") == "prestige_helper", 5).otherwise(9)
    return rows.join(of, "holder").select(*_KEY, "dynasty_id", F.col("holder").alias("character_id"), level.alias("minimum_level"))


def adventurers(effects_in_force: DataFrame, installed: Installed) -> DataFrame:
    """Adventurer bodies that ran under a plain holder and the adventurer law: _KEY, required_date."""
    if forms.LANDLESS not in installed.packages:
        return effects_in_force.where("false").select(*_KEY, "required_date")
    ruled = F.col("plain_holder").isNotNull() & F.coalesce(F.array_contains("laws", ADVENTURER_LAW), F.lit(False))
    return effects_in_force.where(F.col("form").isin("adventurer", "adventurer_dated") & ruled).select(*_KEY, "required_date")


def laws_before(found: Read, installed: Installed) -> DataFrame:
    """Effects of any form with `held`: the laws in force just before each, appended ones among them."""
    said = found.said.withColumnRenamed("title_id", "entity_id")
    changes = effects.law_changes(said, installed.laws, added_laws(found.forms, installed).withColumnRenamed("title_id", "entity_id"))
    asked = found.operations.where("operation_key = 'effect'").select(F.col("title_id").alias("entity_id"), "effective_date", "declaration_order", F.lit(-1).alias("step"))
    return folds.at_instants(changes, asked, "entity_id", effects.LAW_ORDER).select(F.col("entity_id").alias("title_id"), "effective_date", "declaration_order", "held")


def special_titles(effects_in_force: DataFrame, assignments: DataFrame, installed: Installed) -> DataFrame:
    if not {forms.COURT, forms.EASTERN} <= set(installed.packages):
        return effects_in_force.where("false").select(*_KEY, "value")
    rows = effects_in_force.where("form = 'special_title'").join(assignments.select(*_KEY), _KEY, "left_semi")
    return _has(rows, "value", installed.titles, "title_id", "there").where("there").select(*_KEY, "value")


def ceremonial_titles(effects_in_force: DataFrame, installed: Installed) -> DataFrame:
    return _has(effects_in_force.where("form = 'ceremonial_title'"), "value", installed.titles, "title_id", "there").where("there").select(*_KEY, "value")


def added_laws(effects_in_force: DataFrame, installed: Installed) -> DataFrame:
    """The one certified body that adds a law to those in force."""
    if forms.EASTERN not in installed.packages:
        return effects_in_force.where("false").select(*_KEY, "value", "required_date")
    rows = _has(effects_in_force.where("form = 'added_law'"), "value", installed.laws, "id", "there")
    return _has(rows, "title_id", installed.titles, "title_id", "known").where("there and known").select(*_KEY, "value", "required_date")


def title_variables(special: DataFrame, ceremonial: DataFrame, adventurer: DataFrame, cutoff: int) -> DataFrame:
    """The last value of each title's variables: title_id, variable_name, value_kind, text_value, effective_date, declaration_order."""
    every = (
        special.select(*_KEY, F.lit("administrative_ui_special_title").alias("variable_name"), F.lit("title").alias("value_kind"), F.col("value").alias("text_value"))
        .unionByName(ceremonial.select(*_KEY, F.lit("ceremonial_title").alias("variable_name"), F.lit("title").alias("value_kind"), F.col("value").alias("text_value")))
        .unionByName(adventurer.select(*_KEY, F.lit("adventurer_creation_reason").alias("variable_name"), F.lit("flag").alias("value_kind"), F.lit("historical").alias("text_value")))
    )
    last = F.max_by(F.struct("value_kind", "text_value", "effective_date", "declaration_order"), F.struct("effective_date", "declaration_order"))
    return every.where(F.col("effective_date") <= cutoff).groupBy("title_id", "variable_name").agg(last.alias("x")).select("title_id", "variable_name", "x.*")


def _event(rows: DataFrame, reading: str, step: int | Column, event_type: Column | str, text: Column, note: Column | None = None, *, owner: Column | None = None, number: Column | None = None, status: Column | None = None, required: Column | None = None, complete: Column | None = None) -> DataFrame:
    """Rows of EVENT. step: a number, or the column that holds it."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    nothing = F.lit(None)
    return rows.select(
        *_KEY, F.lit(reading).alias("reading"), (F.lit(step) if isinstance(step, int) else step).alias("step"), F.coalesce(owner, F.col("title_id")).alias("owner_id") if owner is not None else F.col("title_id").alias("owner_id"), kind.alias("event_type"), text.cast("string").alias("text_value"),
        (nothing if number is None else number).cast("bigint").alias("integer_value"), (F.lit("valid") if status is None else status).alias("validation_status"), (nothing if note is None else note).cast("string").alias("validation_note"),
        (nothing if required is None else required).cast("int").alias("required_date"), (F.lit(True) if complete is None else complete).alias("complete"),
    )


def _noop(rows: DataFrame, reading: str, step: int, kind: str, flag: str, package: str, what: str, required: Column | None = None) -> DataFrame:
    return _event(rows, reading, step, kind, F.lit(flag), F.lit(f"installed {package} makes {what} condition false"), required=required)


def candidates(found: Read, installed: Installed, cutoff: int) -> DataFrame:
    """Every valid reading of every operation: EVENT."""
    here, said = found.forms, found.said
    court = court_assignments(here, installed, cutoff)
    special, ceremonial, faith = special_titles(here, court, installed), ceremonial_titles(here, installed), state_faiths(here, court, installed, cutoff)
    adventure, bound, law = adventurers(here, installed), prestige_bounds(here, installed, cutoff), added_laws(here, installed)
    value, packages = F.col("value"), installed.packages
    holds = F.concat(F.lit("holder="), "character_id")
    out = [
        _event(court, "court", 0, F.concat("field", F.lit("_set")), value, F.concat(holds, F.lit(f"; installed {forms.COURT}")), complete=F.col("complete")),
        _event(court.where("learned is not null"), "court", 1, F.when(F.col("learned"), "court_language_learned").otherwise("court_language_learning_noop"), value, F.concat(holds, F.when(F.col("learned"), "; history_granted").otherwise("; already_known")), complete=F.col("complete")),
        _event(special, "special_title", 0, "title_variable_set", F.concat(F.lit("administrative_ui_special_title="), value), F.lit("value_kind=title")),
        _event(faith, "state_faith", 0, "state_faith_set", F.col("faith_id"), F.concat(holds, F.lit("; government=administrative_government"))),
        _noop(faith, "state_faith", 1, "dlc_gated_conditional_noop", forms.LANDLESS, packages.get(forms.LANDLESS, ""), "government fallback"),
        _event(bound, "prestige", 0, "dynasty_prestige_minimum_established", F.col("dynasty_id"), F.concat(holds, F.lit("; lower_bound_only")), number=F.col("minimum_level")),
        _event(ceremonial, "ceremonial_title", 0, "title_variable_set", F.concat(F.lit("ceremonial_title="), value), F.lit("value_kind=title")),
        _event(adventure, "adventurer", 0, "landless_adventurer_history_initialized", F.lit(ADVENTURER_LAW), F.lit("explicit title law makes helper idempotent")),
        _event(adventure, "adventurer", 1, "title_variable_set", F.lit("adventurer_creation_reason=historical"), F.lit("value_kind=flag")),
        _noop(adventure.where("required_date is not null"), "adventurer", 2, "dlc_gated_noop", forms.LANDLESS, packages.get(forms.LANDLESS, ""), "destruction", F.col("required_date")),
        _event(law, "added_law", 0, "title_law_added", value, F.lit("installed law ID added to the active explicit title-law set")),
        _noop(law, "added_law", 1, "dlc_gated_noop", forms.EASTERN, packages.get(forms.EASTERN, ""), "destruction", F.col("required_date")),
    ]
    for form, flag, kind, what in (("eastern_noop", forms.EASTERN, "dlc_gated_noop", "destruction"), ("landless_noop", forms.LANDLESS, "dlc_gated_noop", "destruction"), ("government_fallback", forms.LANDLESS, "dlc_gated_conditional_noop", "government fallback")):
        if flag in packages:
            reading = "fallback" if form == "government_fallback" else form
            out.append(_noop(here.where(F.col("form") == form), reading, 0, kind, flag, packages[flag], what, F.col("required_date")))
    out += [capital_events(said, installed.titles), law_events(said, installed.laws), de_jure_events(said, installed.titles), tributary_events(said, installed), name_events(said, installed.labels), plain_events(found.operations)]
    return reduce(DataFrame.unionByName, out)


def capital_events(said: DataFrame, titles: DataFrame) -> DataFrame:
    """Each capital effect of a body, valid or not; the owner of a barony's is its parent."""
    own = titles.select("title_id", "parent_title_id", F.col("title_rank").alias("own_rank"))
    named = titles.select(F.col("title_id").alias("value"), F.col("title_rank").alias("named_rank"))
    rows = said.where(F.col("kind").startswith("capital")).join(own, "title_id", "left").join(named, "value", "left")
    county, bound = F.col("kind") == "capital_county", F.col("kind") == "capital_barony_if"
    seated = (F.col("value") == "yes") & F.col("parent_title_id").isNotNull() & F.coalesce(F.col("own_rank") == "barony", F.lit(False))
    ok = F.when(county, F.coalesce(F.col("named_rank") == "county", F.lit(False)) & F.col("value").startswith("c_")).when(bound, seated & F.col("required_date").isNotNull()).otherwise(seated)
    why = F.when(ok, F.lit(None)).when(county, "capital county target is not an installed county").when(bound, "unsupported conditional capital barony effect").otherwise("capital barony requires yes on a parented barony")
    kind = F.when(county, "set_capital_county").otherwise("set_capital_barony")
    text = F.when(county, F.col("value")).otherwise(F.col("title_id"))
    owner = F.when(~county, F.coalesce("parent_title_id", "title_id"))
    return _event(rows, "capital", F.col("step"), kind, text, why, owner=owner, status=F.when(ok, "valid").otherwise("warning"), required=F.col("required_date"))


def law_events(said: DataFrame, laws: DataFrame) -> DataFrame:
    """Lists of laws that are all installed replace those before; an empty list clears them."""
    rows = _has(said.where("kind = 'law'"), "value", laws, "id", "there")
    lists = rows.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("laws"), F.max(F.col("value").isNotNull() & ~F.col("there")).alias("lacking"))
    text = F.array_join(F.transform("laws", lambda x: F.coalesce(x["value"], F.lit(""))), ",")
    return _event(lists.where(~F.col("lacking")), "laws", 0, "succession_laws_replaced", text, F.lit("installed law IDs replace the prior explicit title-law set"))


def de_jure_events(said: DataFrame, titles: DataFrame) -> DataFrame:
    """De jure lieges that are installed and another title; 0 clears."""
    rows = _has(said.where("kind = 'de_jure_liege'"), "value", titles, "title_id", "there").where("value is null or (there and value <> title_id)")
    why = F.when(F.col("operation_key") == "effect", "effect-form title-scope de-jure replacement").otherwise("dated title-history declaration replaces dynamic de-jure parentage")
    return _event(rows, "de_jure", 0, "de_jure_liege_replaced", F.col("value"), why)


def tributary_events(said: DataFrame, installed: Installed) -> DataFrame:
    rows = _has(_has(said.where("kind = 'tributary'"), "value", installed.titles, "title_id", "there"), "second", installed.groups, "id", "group_there")
    return _event(rows.where("there and group_there and value <> title_id"), "tributary", 0, "tributary_relationship_replaced", F.col("value"), F.concat(F.lit("contract_group="), "second"))


def name_events(said: DataFrame, labels: DataFrame) -> DataFrame:
    """Names whose key has a label, and resets."""
    rows = said.where("kind = 'name'").join(labels.select(F.col("localization_key").alias("value"), "display_name"), "value", "left")
    reset = F.col("value").isNull()
    kind = F.when(reset, "title_name_override_reset").otherwise("title_name_override_set")
    return _event(rows.where(reset | F.col("display_name").isNotNull()), "name", 0, kind, F.col("value"), F.when(reset, "default title localization restored").otherwise(F.concat(F.lit("display_name="), "display_name")))


def plain_events(operations: DataFrame) -> DataFrame:
    """Holders, lieges, governments and development as they are declared."""
    key, value = F.col("operation_key"), F.col("scalar_value")
    grows = key == "change_development_level"
    number = states.whole_number(value)
    bad = grows & number.isNull()
    bypass = F.when(value == "0", "explicit title clear with head-of-faith eligibility bypass").otherwise("holder assigned with head-of-faith eligibility bypass")
    note = F.when(bad, "development delta is not an integer").when(key == states.HOLDER_KEYS[1], bypass)
    rows = operations.where(key.isin(*states.TITLE_KEYS))
    return _event(rows, "plain", 0, key, F.when(~grows | bad, value), note, number=F.when(grows, number), status=F.when(bad, "warning").otherwise("valid"))


def title_events(found: Read, installed: Installed, cutoff: int) -> DataFrame:
    """The events of each operation by the first reading that holds, in order: EVENT's columns without complete, and event_sequence, which counts a title's events."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("reading"))
    every = candidates(found, installed, cutoff).withColumn("rank", rank)
    # A few readings an operation at most.
    own = Window.partitionBy(*_KEY)
    first = F.min(F.when(F.col("complete"), F.col("rank"))).over(own)
    kept = every.withColumn("first", first).where((F.col("rank") == F.col("first")) | (F.col("reading") == "court"))
    order = Window.partitionBy("title_id").orderBy("effective_date", "declaration_order", "rank", "step", "event_type")
    return kept.withColumn("event_sequence", F.row_number().over(order)).drop("rank", "first", "complete")


def evaluated(every: DataFrame, said: DataFrame) -> DataFrame:
    """Operations that are said whole (_KEY). every: candidates; said: of Read. A court assignment or a capital that leaves something of its body out doesn't count."""
    whole = every.where("complete and reading <> 'capital' and reading <> 'plain'").select(*_KEY)
    capitals = said.where(F.col("complete") & F.col("kind").startswith("capital")).select(*_KEY)
    return whole.unionByName(capitals).distinct()


def name_overrides(events: DataFrame, cutoff: int) -> DataFrame:
    """The name in force of each title: localization_key, display_name (both null after a reset), status."""
    rows = events.where((F.col("reading") == "name") & (F.col("effective_date") <= cutoff))
    last = F.max_by(F.struct("text_value", "validation_note", "event_type", "effective_date", "declaration_order"), F.struct("effective_date", "declaration_order"))
    x = rows.groupBy("title_id").agg(last.alias("x"))
    reset = F.col("x.event_type") == "title_name_override_reset"
    return x.select("title_id", F.col("x.text_value").alias("localization_key"), F.when(~reset, F.substring_index("x.validation_note", "display_name=", -1)).alias("display_name"), F.when(reset, "explicit_default").otherwise("declared").alias("status"), "x.effective_date", "x.declaration_order")
