"""The engine's catalogue against DuckDB, and its operators on small fixtures."""

from __future__ import annotations

import duckdb
import pytest

from annalist.functions import script
from annalist.operators import hierarchy, replay
from annalist.plans import catalogue


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in frame.collect())
    cur = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())


def test_script_assignments():
    text = 'k_x = { # note { \n 867.1.1 = { holder = 7 liege = "a \\"b\\"" }\n 866.2.31 = { holder = 0 } }\nother = yes'
    top = list(script.assignments(script.without_comments(text)))
    assert [(a.key, a.kind, a.line_start, a.line_end) for a in top] == [("k_x", "block", 1, 3), ("other", "scalar", 4, 4)]
    inner = list(script.assignments(top[0].raw[1:-1], top[0].line_start))
    assert [script.date_key(a.key) for a in inner] == [8670101, 8660231]
    assert [script.scalar(a.raw) for a in script.assignments(inner[0].raw[1:-1])] == ["7", 'a "b"']
    assert script.date_key("867.1") is None and script.date_key("867.2.31") == 8670231
    for bad in ("867.13.1", "867.1.32"):
        with pytest.raises(ValueError):
            script.date_key(bad)
    assert script.decoded(b"\xe9") == "é" and script.decoded(b"\xef\xbb\xbfx") == "x"
    with pytest.raises(ValueError):
        list(script.assignments("a = { b = 1"))


def test_script_keys_values_and_errors():
    found = [(a.key, a.raw, a.kind) for a in script.assignments('title:k_x = { holder = 1 } @v = 3 x = b=c key ?= { inner = 2 } NOT = { level < 5 }')]
    assert found == [("k_x", "{ holder = 1 }", "block"), ("v", "3", "scalar"), ("x", "b=c", "scalar"), ("inner", "2", "scalar"), ("NOT", "{ level < 5 }", "block")]
    for bad in ('a = "open', 'a = { b = "}', "a = { b = { } "):
        with pytest.raises(ValueError, match="unclosed"):
            list(script.assignments(bad))
    assert script.shape('{ a = { b = 1 c = "x" } d = yes }') == "a{b=<scalar>+c=<scalar>}+d=<scalar>"


def test_script_history(spark):
    files = spark.createDataFrame([("a.txt", b"k_x = { name = y 867.1.1 = { holder = 7 } 868.1.1 = { holder = 0 government = g } }"), ("b.txt", b"")], "path string, content binary")
    rows = [(r.entity_id, r.declaration_order, r.effective_date, r.operation_key, r.raw_value) for r in script.history(files).orderBy("declaration_order").collect()]
    assert rows == [("k_x", 0, None, "name", "y"), ("k_x", 1, 8670101, "holder", "7"), ("k_x", 2, 8680101, "holder", "0"), ("k_x", 3, 8680101, "government", "g")]
    titles = script.history(files, script.TITLE_ID, static=False)
    assert [(r.operation_key, r.operation_order) for r in titles.orderBy("declaration_order").collect()] == [("holder", 1), ("holder", 1), ("government", 2)]
    with pytest.raises(Exception, match="impossible date"):
        script.history(spark.createDataFrame([("a", b"k_x = { 867.13.1 = { holder = 7 } }")], "path string, content binary")).collect()


def test_hierarchy_outcomes(spark):
    rows = [("e_1", None), ("k_1", "e_1"), ("d_1", "k_1"), ("c_1", "d_1"), ("b_1", "c_1"), ("c_2", "e_1"), ("c_3", "d_9"), ("d_2", "k_1"), ("d_2", "k_1"), ("k_2", "k_3"), ("k_3", "k_2")]
    got = {r.title_id: r.warning for r in hierarchy.validated(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "title_id string, parent_title_id string, source_order long")).collect()}
    assert got == {"e_1": None, "k_1": None, "d_1": None, "c_1": None, "b_1": None, "c_2": "non-canonical rank chain: ce", "c_3": "missing parent title: d_9", "d_2": "duplicate title declarations", "k_2": "cyclic parent hierarchy", "k_3": "cyclic parent hierarchy"}


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_resolved_chains(spark):
    titles = [("e_1", "empire", None, True), ("k_1", "kingdom", "e_1", True), ("d_1", "duchy", "k_1", True), ("c_1", "county", "d_1", True), ("b_1", "barony", "c_1", True), ("c_2", "county", "k_1", True), ("b_2", "barony", "c_2", True), ("c_3", "county", None, True), ("b_9", "barony", "c_1", False), ("e_2", "empire", "e_1", True)]
    frame = spark.createDataFrame(titles, "title_id string, title_rank string, parent_title_id string, selectable boolean")
    starts = spark.createDataFrame([(x,) for x in ("b_1", "k_1", "b_2", "c_3", "b_9", "e_2", "zz")], "title_id string")
    got = {r.title_id: (r.error, r.empire, r.barony) for r in hierarchy.resolved(starts, frame).collect()}
    assert got == {
        "b_1": (None, "e_1", "b_1"), "k_1": (None, "e_1", None), "b_2": ("Invalid parent for title: c_2", None, None), "c_3": ("Incomplete title hierarchy above: c_3", None, None), "b_9": ("Unknown or non-selectable title: b_9", None, None),
        "e_2": ("Empire title cannot have a parent title", None, None), "zz": ("Unknown or non-selectable title: zz", None, None),
    }


def test_overlay_refuses_repeated_keys(spark):
    base = spark.createDataFrame([(1, 2)], "k int, v int")
    assert replay.overlay(base, base.limit(0), "k", ["v"]).collect() == [(1, 2)]
    with pytest.raises(Exception, match="repeated"):
        replay.overlay(base, base.union(base), "k", ["v"]).collect()


def test_pointer_doubling_takes_few_rounds(spark, monkeypatch):
    from annalist.operators import pointers

    rounds = []
    plain = pointers.written
    monkeypatch.setattr(pointers, "written", lambda *a: rounds.append(1) or plain(*a))
    # A way of 1000 nodes, two circles with ways into them, a way to a node that isn't there, and a lone node.
    edges = [(f"a{k}", f"a{k + 1}" if k < 999 else None, [f"a{k}"]) for k in range(1000)]
    edges += [("c0", "c1", None), ("c1", "c2", None), ("c2", "c0", None), ("c3", "c2", None), ("s", "s", None), ("m", "gone", ["m"]), ("n", "m", ["n"]), ("x", None, None)]
    got = {r.node: r for r in pointers.resolved(spark.createDataFrame(edges, "node string, next string, along array<string>")).collect()}
    assert all(got[f"a{k}"].end == "a999" and got[f"a{k}"].along == [f"a{j}" for j in range(k, 1000)] and not got[f"a{k}"].cyclic for k in range(0, 1000, 37))
    assert {k for k, r in got.items() if r.cyclic} == {"c0", "c1", "c2", "c3", "s"}
    assert (got["m"].loose, got["n"].loose, got["n"].end, got["n"].along) == ("gone", "gone", "m", ["n", "m"])
    assert (got["x"].end, got["x"].loose, got["x"].cyclic) == ("x", None, False)
    assert len(rounds) <= 13
    with pytest.raises(ValueError, match="several pointers"):
        pointers.resolved(spark.createDataFrame(edges + edges[:1], "node string, next string, along array<string>"))


def test_hierarchy_with_many_odd_titles(spark):
    """120,000 baronies in chains of 20, each chain under a county."""
    titles = spark.range(120_000).selectExpr("concat('b_', id) AS title_id", "CASE WHEN id % 20 = 19 THEN 'c_1' ELSE concat('b_', id + 1) END AS parent_title_id", "id AS source_order")
    county = spark.createDataFrame([("c_1", "d_1", 0), ("d_1", "k_1", 0), ("k_1", "e_1", 0), ("e_1", None, 0)], "title_id string, parent_title_id string, source_order long")
    found = hierarchy.validated(titles.unionByName(county)).groupBy("warning").count().collect()
    assert {r.warning: r["count"] for r in found} == {None: 6_004} | {f"non-canonical rank chain: {'b' * k}cdke": 6_000 for k in range(2, 21)}


def test_labels_follow_long_aliases(spark):
    labels = [(f"k{j}", f"$k{j + 1}$" if j < 99 else "end") for j in range(100)] + [("loop", "$loop$"), ("lost", "$none$"), ("to_loop", "$loop$")]
    frame = spark.createDataFrame(labels, "localization_key string, display_value string")
    got = {r.localization_key: r.display_name for r in hierarchy.followed(frame.select("localization_key"), frame).collect()}
    assert got == {f"k{j}": "end" for j in range(100)}
