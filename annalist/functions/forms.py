"""Bodies of reviewed form. A form is itself a piece of script in which $name$ stands for a value that is read out.

A body has a form if both have the same keys, blocks and values in the same order. What a body of a form means depends on when it
runs and who holds the title then; that is said by operators, not here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import script

Tree = tuple[tuple[str, "str | Tree"], ...]

# Feature flags, the reviewed forms of effect bodies, and where some of them are allowed.
COURT, LANDLESS, EASTERN = "royal_court", "roads_to_power", "all_under_heaven"
_COURT_LIMIT = f"limit = {{ exists = holder has_dlc_feature = {COURT} }}"
FORMS = {
    "eastern_noop": "{ destroy_landless_title_no_tgp_dlc_effect = { DATE = $date$ } }",
    "landless_noop": "{ destroy_landless_title_no_dlc_effect = { DATE = $date$ } }",
    "government_fallback": f"""{{ if = {{ limit = {{ exists = holder NOT = {{ has_dlc_feature = {LANDLESS} }} }}
        holder = {{ empty_treasury_when_abandoning_landed_life_effect = yes change_government = feudal_government }} }} }}""",
    "added_law": "{ add_title_law = $value$ destroy_landless_title_no_tgp_dlc_effect = { DATE = $date$ } }",
    "adventurer": "{ create_landless_adventurer_title_history_effect = yes set_variable = { name = adventurer_creation_reason value = flag:$value$ } }",
    "adventurer_dated": "{ create_landless_adventurer_title_history_effect = yes set_variable = { name = adventurer_creation_reason value = flag:$value$ } destroy_landless_title_no_dlc_effect = { DATE = $date$ } }",
    "ceremonial_title": "{ set_variable = { name = ceremonial_title value = title:$value$ } }",
    "special_title": f"""{{ if = {{ {_COURT_LIMIT} holder = {{ set_court_language = language_chinese }} }}
        if = {{ limit = {{ has_tgp_dlc_trigger = yes }} set_variable = {{ name = administrative_ui_special_title value = title:$value$ }} }} }}""",
    "state_faith": f"""{{ if = {{ limit = {{ exists = holder holder = {{ has_government = administrative_government }} }} set_state_faith = faith:$value$ }}
        if = {{ {_COURT_LIMIT} holder = {{ set_court_type = court_intrigue }} }}
        if = {{ limit = {{ exists = holder NOT = {{ has_dlc_feature = {LANDLESS} }} }} holder = {{ change_government = feudal_government add_realm_law_skip_effects = single_heir_succession_law }} }} }}""",
    "prestige_helper": "{ tgp_set_minamoto_taira_dynasty_prestige_effect = yes }",
}
DIRECT_PRESTIGE = "{ holder.dynasty ?= { while = { limit = { dynasty_prestige_level < 9 } add_dynasty_prestige_level = 1 } } }"
COURT_FORMS = {
    "court_language": f"{{ {_COURT_LIMIT} holder = {{ set_court_language = $value$ }} }}",
    "court_language_learned": f"{{ {_COURT_LIMIT} holder = {{ set_court_language = $value$ if = {{ limit = {{ NOT = {{ knows_court_language_of = this }} }} learn_court_language_of = this }} }} }}",
    "court_type": f"{{ {_COURT_LIMIT} holder = {{ set_court_type = $value$ }} }}",
}
COURT_IDS = {"court_language": r"language_[A-Za-z0-9_-]+", "court_language_learned": r"language_[A-Za-z0-9_-]+", "court_type": r"court_[A-Za-z0-9_-]+"}
#: form: (title, date, value) that alone may have it.
PLACES = {"added_law": ("k_chrysanthemum_throne", 8670101, "single_heir_succession_law"), "special_title": ("e_japan", 8670101, None), "state_faith": ("e_byzantium", 8660101, "orthodox"), "adventurer": (None, None, "historical"), "adventurer_dated": (None, None, "historical")}
#: A title whose court may be set in one file and one way only.
ONE_COURT = ("k_balhae", "history/titles/k_balhae.txt", 8670101, ("court_language", "language_chinese", True))
#: Reviewed helper bodies, by the file and the name that define them.
HELPERS = {
    ("common/scripted_effects/10_dlc_tgp_scripted_effects.txt", "destroy_landless_title_no_tgp_dlc_effect"): "{ if = { limit = { NOT = { has_dlc_feature = all_under_heaven } game_start_date = $DATE$ } holder ?= { empty_treasury_when_abandoning_landed_life_effect = yes destroy_title = prev } } }",
    ("common/scripted_triggers/00_has_dlc_scripted_triggers.txt", "has_tgp_dlc_trigger"): "{ has_dlc_feature = all_under_heaven }",
    ("common/scripted_effects/10_dlc_tgp_japan_scripted_effects.txt", "tgp_set_minamoto_taira_dynasty_prestige_effect"): "{ holder.dynasty ?= { while = { limit = { dynasty_prestige_level < 5 } add_dynasty_prestige_level = 1 } } }",
    ("common/scripted_effects/07_dlc_ep3_scripted_effects.txt", "destroy_landless_title_no_dlc_effect"): "{ if = { limit = { NOT = { has_dlc_feature = roads_to_power } game_start_date = $DATE$ } holder ?= { empty_treasury_when_abandoning_landed_life_effect = yes destroy_title = prev } } }",
    ("common/scripted_effects/07_dlc_ep3_scripted_effects.txt", "create_landless_adventurer_title_history_effect"): "{ holder ?= { if = { limit = { NOT = { has_realm_law = landless_adventurer_succession_law } } add_realm_law = landless_adventurer_succession_law } } }",
}


@lru_cache(maxsize=256)
def tree(raw: str) -> Tree:
    """A block as nested (key, value or block). The few blocks that were parsed last are kept."""
    return tuple((a.key, tree(a.raw) if a.kind == "block" else script.scalar(a.raw)) for a in script.assignments(raw[1:-1]))


def compare(form: Tree, body: Tree, found: dict[str, str]) -> bool:
    """Whether a body has a form; values that $name$ stands for are put into found."""
    if len(form) != len(body):
        return False
    for (key, wanted), (name, said) in zip(form, body):
        if key != name or isinstance(wanted, str) != isinstance(said, str):
            return False
        if not isinstance(wanted, str):
            if not compare(wanted, said, found):
                return False
        elif "$" in wanted:
            before, slot, after = wanted.split("$")
            if not (said.startswith(before) and said.endswith(after) and len(said) > len(before) + len(after)):
                return False
            found[slot] = said[len(before) : len(said) - len(after)]
        elif wanted != said:
            return False
    return True


_TREES = {name: tree(text) for name, text in FORMS.items()}
_COURT_TREES = {name: tree(text) for name, text in COURT_FORMS.items()}

Event = tuple[str, "str | None", "int | None", bool]


def court(title: str, path: str, date: int, body: Tree) -> Event | None:
    """The one court assignment among a body's branches: kind, value, -, whether the body says nothing else."""
    matches = []
    for key, branch in body:
        for name, form in _COURT_TREES.items():
            found: dict[str, str] = {}
            if key == "if" and not isinstance(branch, str) and compare(form, branch, found) and re.fullmatch(COURT_IDS[name], found["value"]):
                matches.append((name, found["value"], len(body) == 1))
    if len(matches) != 1:
        return None
    there = path.replace("\\", "/").endswith(ONE_COURT[1])
    if (title == ONE_COURT[0] or there) and (title, there, date, matches[0]) != (ONE_COURT[0], True, *ONE_COURT[2:]):
        return None
    name, value, whole = matches[0]
    return name, value, None, whole


def events(title: str, path: str, date: int, key: str, kind: str, raw: str) -> list[Event]:
    """What an effect's body says by its form: (form, value, required date, whether that is all it says)."""
    if key != "effect" or kind != "block":
        return []
    out: list[Event] = []
    body = tree(raw)
    assigned = court(title, path, date, body)
    if assigned:
        out.append(assigned)
    for name, form in _TREES.items():
        found: dict[str, str] = {}
        if not compare(form, body, found):
            continue
        required = script.date_key(found["date"]) if "date" in found else None
        where, when, value = PLACES.get(name, (None, None, None))
        if "date" in found and required != date or where and where != title or when and when != date or value and value != found.get("value"):
            continue
        out.append((name, found.get("value"), required, True))
    if " ".join(raw.split()) == DIRECT_PRESTIGE:
        out.append(("prestige_direct", None, None, True))
    return out


_RECOGNISED = "entity_id string, effective_date int, declaration_order long, form string, value string, required_date int, complete boolean"


def recognised(operations: DataFrame) -> DataFrame:
    """Forms of operations (entity_id, path, effective_date, declaration_order, operation_key, value_kind, raw_value). Operations of no form give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RECOGNISED.split(", ")]
        for batch in batches:
            rows = []
            for entity, path, date, order, key, kind, raw in batch.itertuples(index=False):
                rows += [(entity, date, order, *x) for x in events(entity, path or "", int(date), key, kind, raw or "")]
            yield pd.DataFrame(rows, columns=names).astype({"effective_date": "Int32", "required_date": "Int32"})

    wanted = operations.where("operation_key = 'effect' and value_kind = 'block' and effective_date is not null")
    return wanted.select("entity_id", "path", "effective_date", "declaration_order", "operation_key", "value_kind", "raw_value").mapInPandas(run, _RECOGNISED)


def helper_problems(declared: DataFrame) -> DataFrame:
    """Of declarations of script files: reviewed helpers whose installed body isn't, but for white space, the reviewed one, or that aren't defined just once (rule, subject)."""
    spark = declared.sparkSession
    wanted = spark.createDataFrame([(path, name, body) for (path, name), body in HELPERS.items()], "path string, name string, body string")
    rows = declared.where("kind = 'block' and size(keys) = 1").select("path", F.element_at("keys", 1).alias("name"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("said"))
    counted = wanted.join(rows, ["path", "name"], "left").groupBy("path", "name", "body").agg(F.count("said").alias("n"), F.min("said").alias("said"))
    return counted.where("n <> 1 or said <> body").select(F.lit("reviewed helper changed").alias("rule"), F.concat_ws(":", "path", "name").alias("subject"))
