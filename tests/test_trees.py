"""Hash trees and paged sections on small fixtures."""

from __future__ import annotations

from annalist.operators import inspection, readiness, trees

ROWS = "path string, content string"


def test_tree_is_free_of_order_and_counts_repeats(spark):
    rows = [("a", "1"), ("b", None), (None, "2"), ("b", None)]
    one, other, once = (spark.createDataFrame(r, ROWS) for r in (rows, rows[::-1], rows[:3]))
    of = lambda frame: {(r.prefix, r.n, r.sha256) for r in trees.tree(frame, ["path"]).collect()}
    assert of(one) == of(other) != of(once)
    assert trees.roots(one, ["path"]).collect()[0].n == 4 and trees.roots(one.limit(0), ["path"]).count() == 0
    # Values that only differ in where one ends and the next begins aren't alike, nor are null and a dash.
    for a, b in ((("ab", "c"), ("a", "bc")), (("-", "x"), (None, "x")), (("", None), (None, ""))):
        assert of(spark.createDataFrame([a], ROWS)) != of(spark.createDataFrame([b], ROWS))


def test_differences_name_the_paths(spark):
    old = [(f"p{k}", str(k % 7)) for k in range(3000)] + [(None, "n")]
    new = [(p, "x" if p in ("p5", "p77") else c) for p, c in old if p not in ("p8", None)] + [("new", "1"), ("p9", "again")]
    a, b = spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS)
    found = trees.differences(a, b, trees.tree(a, ["path"]), trees.tree(b, ["path"]), ["path"])
    assert {tuple(r) for r in found.collect()} == {("p5", "changed"), ("p77", "changed"), ("p8", "removed"), (None, "removed"), ("new", "added"), ("p9", "changed")}
    assert trees.differences(a, a, trees.tree(a, ["path"]), trees.tree(a, ["path"]), ["path"]).count() == 0


def test_changed_manifest_makes_a_report_stale(spark):
    runs = spark.createDataFrame([("r1", "installed_faiths", "1.0.0", "completed", "2024")], "parser_run_id string, parser_name string, parser_version string, status string, started_at string")
    shape = "source_group string, relative_path string, sha256 string, byte_size long, modified_at string, parser_run_id string"
    files = [[("installed_faiths", f"f{k}", sha, 1, "t", "r1") for k in range(3)] for sha in ("a", "b")]
    old, new = (readiness.bindings(runs, spark.createDataFrame(f, shape)) for f in files)
    assert readiness.changed_bindings(old, old).collect()[0].evidence_status == "current"
    told = readiness.changed_bindings(old, new).collect()[0]
    assert (told.evidence_status, told.evidence_detail) == ("stale", "Evidence changed for: installed_faiths.")
    assert readiness.changed_bindings(old.where("false"), new).collect()[0].evidence_status == "stale"


def test_sections_are_paged(spark):
    nodes = spark.createDataFrame([("k", None, "K", "kingdom", True, "valid", None)] + [(f"d{n:02}", "k", "same", "duchy", True, "valid", None) for n in range(23)], "title_id string, parent_title_id string, display_name string, title_rank string, selectable boolean, validation_status string, validation_note string")
    tables = {"chain": inspection.title_chain(nodes), "children": nodes.withColumnRenamed("parent_title_id", "owner")}
    rows = {(r.owner, r.page): r for r in inspection.sections(tables, 10).collect()}
    assert [[c.title_id for c in rows["k", p].children] for p in range(3)] == [[f"d{n:02}" for n in range(a, min(a + 10, 23))] for a in (0, 10, 20)]
    assert [c.title_id for c in rows["d07", 0].chain] == ["k", "d07"] and rows["d07", 0].children == [] and len(rows) == 26
