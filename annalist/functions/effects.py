"""Recognisers of history operations that say more than a plain value: laws, de jure lieges, tributaries, names, capitals, learning.

Each is a pure function of one body that gives what it says, or nothing. `recognised` runs them over operations in one pass
of Arrow batches; whether what they name is installed, and which one is in force, is said by joins and grouped aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import script
from annalist.operators import folds

# Forms of title and law ids, and what names a title in a script.
TITLE = re.compile(r"[ekdcb]_[A-Za-z0-9_-]+\Z")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]+\Z")
CHARACTER = re.compile(script.CHARACTER_ID)
SCOPE = "title:"

#: kind, owner (null: the operation's own title), value, second value, date on which it holds alone, order within the body.
EVENT = "kind string, owner string, value string, second string, required_date int, step int"
Found = tuple[str, str | None, str | None, str | None, int | None]


@lru_cache(maxsize=256)
def _inner(raw: str) -> tuple[script.Assignment, ...]:
    """Each recogniser asks for a body's assignments; the few bodies that were parsed last are kept."""
    return tuple(script.assignments(raw[1:-1])) if raw[:1] == "{" else ()


def _plain(a: script.Assignment) -> str | None:
    return script.scalar(a.raw) if a.kind == "scalar" else None


def _unscoped(text: str | None) -> str | None:
    return text[len(SCOPE) :] if text and text.startswith(SCOPE) else None


def laws(key: str, kind: str, raw: str) -> list[Found]:
    """A block of distinct law ids replaces all laws; an empty one clears them (value null)."""
    if key != "succession_laws" or kind != "block":
        return []
    ids = raw[1:-1].split()
    if len(set(ids)) < len(ids) or not all(IDENTIFIER.match(x) for x in ids):
        return []
    return [("law", None, x, None, None) for x in ids] or [("law", None, None, None, None)]


def de_jure(key: str, kind: str, raw: str) -> list[Found]:
    """A scalar, 0 for none, or an effect of that one field with a scoped title."""
    if key == "de_jure_liege" and kind == "scalar":
        return [("de_jure_liege", None, None if raw == "0" else raw, None, None)]
    fields = _inner(raw) if key == "effect" and kind == "block" else ()
    target = _unscoped(_plain(fields[0])) if len(fields) == 1 and fields[0].key == "set_de_jure_liege_title" else None
    return [("de_jure_liege", None, target, None, None)] if target else []


def tributary(key: str, kind: str, raw: str) -> list[Found]:
    fields = _inner(raw) if key == "tributary_of" and kind == "block" else ()
    said = {a.key: _plain(a) or "" for a in fields}
    if len(fields) != 2 or set(said) != {"suzerain", "contract_group"} or not TITLE.match(said["suzerain"]) or not IDENTIFIER.match(said["contract_group"]):
        return []
    return [("tributary", None, said["suzerain"], said["contract_group"], None)]


def name(key: str, kind: str, raw: str) -> list[Found]:
    """name = key, reset_name = yes (value null), or an effect of set_title_name alone."""
    if kind == "scalar" and key == "name":
        return [("name", None, raw, None, None)]
    if kind == "scalar" and (key, raw) == ("reset_name", "yes"):
        return [("name", None, None, None, None)]
    fields = _inner(raw) if key == "effect" and kind == "block" else ()
    said = _plain(fields[0]) if len(fields) == 1 and fields[0].key == "set_title_name" else None
    return [("name", None, said, None, None)] if said else []


def capitals(key: str, kind: str, raw: str) -> list[Found]:
    """Capital counties, capital baronies (the title is its parent's capital), and those bound to one start date."""
    found: list[Found] = []
    for a in _inner(raw) if key == "effect" and kind == "block" else []:
        said = _plain(a)
        if a.key == "set_capital_county" and said is not None:
            found.append(("capital_county", None, said.removeprefix(SCOPE), None, None))
        elif a.key == "set_capital_barony" and said is not None:
            found.append(("capital_barony", None, said, None, None))
        elif a.key == "if" and a.kind == "block":
            parts = _inner(a.raw)
            limit = [p for p in parts if p.key == "limit" and p.kind == "block"]
            setter = [_plain(p) for p in parts if p.key == "set_capital_barony" and p.kind == "scalar"]
            bounds = _inner(limit[0].raw) if len(limit) == len(setter) == 1 and len(parts) == 2 else []
            if len(bounds) == 1 and bounds[0].key == "game_start_date":
                found.append(("capital_barony_if", None, setter[0], None, script.date_key(_plain(bounds[0]) or "")))
    return found


def handled(key: str, kind: str, raw: str) -> bool:
    """Whether capital effects are all that an effect's body says."""
    return key == "effect" and kind == "block" and len(capitals(key, kind, raw)) == len(_inner(raw))


# Flags and relationship effects that change no projected state.
IDLE_FLAGS = frozenset("do_not_generate_starting_family has_scripted_appearance".split())
IDLE_EFFECTS = frozenset(
    "add_opinion break_alliance create_betrothal make_concubine reverse_add_opinion set_father set_primary_spouse set_relation_best_friend set_relation_friend set_relation_lover "
    "set_relation_nemesis set_relation_potential_friend set_relation_potential_rival set_relation_rival set_relation_soulmate".split()
)


def learning(key: str, kind: str, raw: str) -> list[Found]:
    """Languages that a body grants, if it does nothing else; a mixed body grants none."""
    fields = _inner(raw) if key == "effect" and kind == "block" else ()
    said = [_plain(a) or "" for a in fields]
    if not fields or any(a.key != "learn_language_of_culture" or not x.startswith("culture:") or not CHARACTER.fullmatch(x[8:]) for a, x in zip(fields, said)):
        return []
    return [("learn_language", None, x[8:], None, None) for x in said]


def cultures(key: str, kind: str, raw: str) -> list[Found]:
    """Cultures that a body sets, whatever else it says; one that isn't a stable id has no value."""
    found: list[Found] = []
    for a in _inner(raw) if key == "effect" and kind == "block" else []:
        if a.key == "set_culture" and a.kind == "scalar":
            said = (_plain(a) or "").removeprefix("culture:")
            found.append(("set_culture", None, said if CHARACTER.fullmatch(said) else None, said or None, None))
    return found


def character_body_is_read(key: str, kind: str, raw: str) -> bool:
    """Whether a character's effect body holds nothing but what is recognised or changes no projected state."""
    fields = _inner(raw) if key == "effect" and kind == "block" else ()
    if learning(key, kind, raw):
        return True

    def read(a: script.Assignment) -> bool:
        if a.key == "set_culture":
            return a.kind == "scalar"
        if a.key == "add_character_flag":
            return a.kind == "scalar" and _plain(a) in IDLE_FLAGS
        return a.key in IDLE_EFFECTS or a.key in ("give_nickname", "remove_nickname")

    return bool(fields) and all(map(read, fields))


def nickname(key: str, kind: str, raw: str) -> list[Found]:
    """Given or removed nicknames, as a scalar or a first-level field of an effect, whatever else the body says. Malformed ones raise."""
    fields = _inner(raw) if key == "effect" and kind == "block" else [script.Assignment(key, raw, kind, 0, 0)]
    found: list[Found] = []
    for a in fields:
        if a.key not in ("give_nickname", "remove_nickname"):
            continue
        said = _plain(a)
        if said is None or (said != "yes" if a.key == "remove_nickname" else not CHARACTER.fullmatch(said)):
            raise ValueError(f"malformed nickname: {a.key} = {a.raw}")
        found.append(("nickname", None, said if a.key == "give_nickname" else None, None, None))
    return found


RECOGNISERS: tuple[Callable[[str, str, str], list[Found]], ...] = (laws, de_jure, tributary, name, capitals, learning, cultures, nickname)


def said_whole(found: list[Found], key: str, kind: str, raw: str) -> bool:
    """Whether what was found is all that the operation says."""
    return bool(found) and (kind == "scalar" or key != "effect" or len(found) == len(_inner(raw)))


def recognised(operations: DataFrame) -> DataFrame:
    """Events of operations (entity_id, effective_date, declaration_order, operation_key, value_kind, raw_value), and whether
    an operation is fully said by them. Operations that nothing recognises give no rows."""
    kept = ["entity_id", "effective_date", "declaration_order"]
    schema = f"entity_id string, effective_date int, declaration_order long, {EVENT}, complete boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for entity, date, order, key, kind, raw in batch[[*kept, "operation_key", "value_kind", "raw_value"]].itertuples(index=False):
                found = [x for f in RECOGNISERS for x in f(key, kind, raw or "")]
                whole = said_whole(found, key, kind, raw or "")
                rows += [(entity, date, order, *x, step, whole) for step, x in enumerate(found)]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"effective_date": "Int32", "required_date": "Int32"})

    return operations.select(*kept, "operation_key", "value_kind", "raw_value").mapInPandas(run, schema)


def read_bodies(operations: DataFrame) -> DataFrame:
    """operations with is_read: whether a character's effect body is read whole."""
    columns = ["entity_id", "effective_date", "declaration_order"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [character_body_is_read(key, kind, raw or "") for key, kind, raw in zip(batch["operation_key"], batch["value_kind"], batch["raw_value"])]
            yield batch[columns].assign(is_read=read).astype({"effective_date": "Int32"})

    return operations.select(*columns, "operation_key", "value_kind", "raw_value").mapInPandas(run, "entity_id string, effective_date int, declaration_order long, is_read boolean")


def known(events: DataFrame, kind: str, installed: DataFrame, column: str = "value") -> DataFrame:
    """Events of a kind whose value is installed (id) or clears, and doesn't name the entity itself."""
    ids = installed.select(F.col("id").alias("_id")).distinct()
    mine = events.where(F.col("kind") == kind)
    found = mine.join(ids, F.col(column) == F.col("_id"), "left")
    return found.where((F.col(column).isNull() | F.col("_id").isNotNull()) & ~F.coalesce(F.col(column) == F.col("entity_id"), F.lit(False))).drop("_id")


def in_force(events: DataFrame, cutoff: int) -> DataFrame:
    """The latest event of each entity up to a date: value, second, its date and order. A clear is a row with a null value."""
    order = F.struct("effective_date", "declaration_order", "step")
    last = F.max_by(F.struct("value", "second", "effective_date", "declaration_order"), order)
    return events.where(F.col("effective_date") <= cutoff).groupBy("entity_id").agg(last.alias("x")).select("entity_id", "x.*", F.when(F.col("x.value").isNull(), "explicit_clear").otherwise("declared").alias("status"))


LAW_ORDER = ["effective_date", "declaration_order", "step"]


def law_changes(events: DataFrame, installed: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """What changes the laws of an entity: entity_id, LAW_ORDER, value, starts (true for the first law of a list that replaces all).

    Lists count whose ids are all installed; an empty list is one row without a value. added: entity_id, effective_date, declaration_order, value of certified
    bodies that append a law to those in force.
    """
    ids = installed.select(F.col("id").alias("_id")).distinct()
    each = events.where(F.col("kind") == "law").join(ids, F.col("value") == F.col("_id"), "left")
    lists = each.groupBy("entity_id", "effective_date", "declaration_order").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("laws"), F.count_if(F.col("value").isNotNull() & F.col("_id").isNull()).alias("lacking"))
    changes = lists.where("lacking = 0").select("entity_id", "effective_date", "declaration_order", F.explode("laws").alias("law")).select("entity_id", "effective_date", "declaration_order", "law.step", "law.value", (F.col("law.step") == 0).alias("starts"))
    if added is None:
        return changes
    return changes.unionByName(added.select("entity_id", "effective_date", "declaration_order", F.lit(0).alias("step"), "value", F.lit(False).alias("starts")))


def laws_in_force(events: DataFrame, installed: DataFrame, cutoff: int, added: DataFrame | None = None) -> DataFrame:
    """Laws in force at a date, with the date and the order of the operation that each came by: entity_id, law_order, law_id, effective_date, declaration_order."""
    changes = law_changes(events, installed, added).where(F.col("effective_date") <= cutoff)
    found = folds.in_force(changes, "entity_id", LAW_ORDER, F.col("starts"))
    return found.select("entity_id", F.col("position").alias("law_order"), F.col("value").alias("law_id"), "effective_date", "declaration_order")


def capital_in_force(events: DataFrame, titles: DataFrame, cutoff: int) -> DataFrame:
    """The latest valid capital of each owner: a county named by it, or a barony that names itself its parent's. titles: title_id, parent_title_id, title_rank."""
    own = titles.select(F.col("title_id").alias("entity_id"), "parent_title_id", F.col("title_rank").alias("own_rank"))
    named = titles.select(F.col("title_id").alias("value"), F.col("title_rank").alias("named_rank"))
    rows = events.where(F.col("kind").startswith("capital")).join(own, "entity_id", "left").join(named, "value", "left")
    county = (F.col("kind") == "capital_county") & (F.col("named_rank") == "county")
    barony = (F.col("kind") != "capital_county") & (F.col("value") == "yes") & F.col("parent_title_id").isNotNull() & (F.col("own_rank") == "barony")
    holds = F.when(F.col("kind") == "capital_barony_if", F.col("required_date") == cutoff).otherwise(True)
    valid = rows.where(county | barony).where(holds)
    owned = valid.select(F.when(county, F.col("entity_id")).otherwise(F.col("parent_title_id")).alias("entity_id"), F.when(county, F.col("value")).otherwise(F.col("entity_id")).alias("value"), "second", "effective_date", "declaration_order", "step")
    return in_force(owned, cutoff)


def first_grants(events: DataFrame, native: DataFrame, cutoff: int) -> DataFrame:
    """First grant of each language that isn't native. native: entity_id, value."""
    mine = events.where((F.col("kind") == "learn_language") & (F.col("effective_date") <= cutoff)).join(native, ["entity_id", "value"], "left_anti")
    return mine.groupBy("entity_id", "value").agg(F.min(F.struct("effective_date", "declaration_order", "step")).alias("at")).select("entity_id", F.col("value").alias("language"), "at.effective_date", "at.declaration_order")


def resolution(superseded: Column, review: Column, normalised: Column) -> Column:
    """The status of a declaration, first that holds."""
    return F.when(superseded, "superseded").when(review, "review_required").when(normalised, "normalized").otherwise("preserved")
