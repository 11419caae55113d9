"""Bookmarks, packages and recognised effects on small written files."""

from __future__ import annotations

from annalist.functions import effects
from annalist.sources import bookmarks as bm

GROUPS = "bm_group_867 = { default_start_date = 867.1.1 }\nbm_group_none = { default_start_date = never }\n"
BOOKMARKS = """bm_a = { group = bm_group_867 is_playable = yes recommended = yes requires_dlc_flag = royal_court weight = { value = 1 }
 character = { name = "n_a" history_id = 1 title = c_a position = { 1 2 } character = { name = "n_b" relation = r history_id = 9 } }
 character = { name = "n_c" history_id = 3 title = c_x } }
bm_b = { group = bm_group_867 start_date = 1066.9.15 requires_dlc_flag = other }
bm_c = { group = lost }
bm_c = { group = lost }
"""


def source(spark, **files):
    return spark.createDataFrame([(k, bytearray(v, "utf-8")) for k, v in files.items()], "path string, content binary")


def test_bookmarks(spark):
    groups = bm.groups(source(spark, g=GROUPS))
    assert {(r.group_id, r.default_start_date) for r in groups.collect()} == {("bm_group_867", "0867-01-01"), ("bm_group_none", None)}
    found = bm.bookmarks(source(spark, b=BOOKMARKS))
    rows = {(r.bookmark_id, r.effective_start_date, r.validation_note, r.at_baseline) for r in bm.normalised(found, groups, "0867-01-01").collect()}
    lost = "bookmark group is missing; effective start date is missing; duplicate bookmark declaration requires review"
    assert rows == {("bm_a", "0867-01-01", None, True), ("bm_b", "1066-09-15", "bookmark date disagrees with group date", False), ("bm_c", "0000-00-00", lost, False)}
    assert {(r.bookmark_id, r.resolution_status, r.resolved_package_id) for r in bm.requirements(found).collect()} == {("bm_a", "resolved", "dlc004_ep1"), ("bm_b", "raw_flag", None)}
    people = bm.characters(source(spark, b=BOOKMARKS))
    assert sorted((r.ordinal, r.parent_ordinal, r.kind, r.history_id, r.name) for r in people.collect()) == [(1, None, "featured", "1", "n_a"), (2, 1, "related", "9", "n_b"), (3, None, "featured", "3", "n_c")]
    states, titles = spark.createDataFrame([("1",)], "character_id string"), spark.createDataFrame([("c_a",)], "title_id string")
    checked = bm.validated_characters(people, states, titles, spark.createDataFrame([("n_a",), ("n_c",)], "localization_key string"))
    assert {r.ordinal: r.validation_note for r in checked.collect()} == {1: None, 2: None, 3: "history character is missing; featured title is missing"}
    good = {"dlc/dlc004_ep1/a.dlc": 'name = "Royal" path = "dlc/dlc004_ep1" pops_id = "ck3_dlc004_ep1" steam_id = "7"'}
    assert bm.package_problems(bm.packages(source(spark, **good)), found).collect() == []
    bad = {"dlc/dlc004_ep1/a.dlc": 'path = "dlc/other" pops_id = "x"'}
    assert [tuple(r) for r in bm.package_problems(bm.packages(source(spark, **bad)), found).collect()] == [("descriptor identity mismatch", "dlc004_ep1")]
    assert [tuple(r) for r in bm.package_problems(bm.packages(source(spark, x="a = b")), found).collect()] == [("descriptor count", "dlc004_ep1")]


OPERATIONS = [
    ("k_a", 8670101, 1, "succession_laws", "block", "{ law_a law_b }"),
    ("k_a", 8680101, 2, "succession_laws", "block", "{ law_a law_z }"),
    ("k_b", 8670101, 3, "succession_laws", "block", "{ law_a }"),
    ("k_b", 8670201, 4, "succession_laws", "block", "{ }"),
    ("c_a", 8670101, 5, "de_jure_liege", "scalar", "d_b"),
    ("c_a", 8670102, 6, "effect", "block", "{ set_de_jure_liege_title = title:d_c }"),
    ("c_b", 8670101, 7, "de_jure_liege", "scalar", "c_b"),
    ("c_c", 8670101, 8, "de_jure_liege", "scalar", "0"),
    ("b_a", 8670101, 9, "effect", "block", "{ set_capital_barony = yes }"),
    ("b_b", 8670102, 10, "effect", "block", "{ if = { limit = { game_start_date = 1066.9.15 } set_capital_barony = yes } }"),
    ("d_b", 8670101, 11, "effect", "block", "{ set_capital_county = title:c_a add_gold = 5 }"),
    ("k_b", 8670101, 12, "tributary_of", "block", "{ suzerain = e_a contract_group = g_a }"),
    ("1", 8670101, 13, "effect", "block", "{ learn_language_of_culture = culture:x learn_language_of_culture = culture:y }"),
    ("1", 8660101, 14, "effect", "block", "{ learn_language_of_culture = culture:z add_gold = 1 }"),
    ("1", 8670103, 15, "effect", "block", "{ give_nickname = nick_a add_gold = 1 }"),
]


def test_effects(spark):
    ops = spark.createDataFrame(OPERATIONS, "entity_id string, effective_date int, declaration_order int, operation_key string, value_kind string, raw_value string")
    events = effects.recognised(ops).cache()
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    cut = 8700101
    assert {tuple(r) for r in effects.laws_in_force(events, ids("law_a", "law_b"), cut).collect()} == {("k_a", 1, "law_a", 8670101, 1), ("k_a", 2, "law_b", 8670101, 1)}
    lieges = effects.in_force(effects.known(events, "de_jure_liege", ids("d_b", "d_c", "c_b")), cut)
    assert {(r.entity_id, r.value, r.status) for r in lieges.collect()} == {("c_a", "d_c", "declared"), ("c_c", None, "explicit_clear")}
    titles = spark.createDataFrame([("b_a", "c_a", "barony"), ("b_b", "c_a", "barony"), ("c_a", "d_b", "county"), ("d_b", None, "duchy")], "title_id string, parent_title_id string, title_rank string")
    assert {(r.entity_id, r.value) for r in effects.capital_in_force(events, titles, cut).collect()} == {("c_a", "b_a"), ("d_b", "c_a")}
    assert {(r.entity_id, r.value) for r in effects.capital_in_force(events, titles, 10660915).collect()} == {("c_a", "b_b"), ("d_b", "c_a")}
    assert {(r.value, r.second) for r in effects.known(events, "tributary", ids("e_a")).collect()} == {("e_a", "g_a")}
    native = spark.createDataFrame([("1", "y")], "entity_id string, value string")
    assert {(r.entity_id, r.language) for r in effects.first_grants(events, native, cut).collect()} == {("1", "x")}
    assert {(r.value, r.complete) for r in events.where("kind = 'nickname'").collect()} == {("nick_a", False)}
    assert effects.recognised(ops.limit(0)).count() == 0
