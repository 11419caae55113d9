"""Sources, sinks and the stream on small written trees."""

from __future__ import annotations

import io
import os
import zipfile

import pytest

from annalist.sources import commits, html_tables, saves, sinks
from annalist.sources import script_files as sf
from annalist.streaming import observations

TREE = {
    "titles/a.txt": "e_x = { # top\n\tcapital = c_y\n\tk_x = {\n\t\td_x = {\n\t\t\tc_y = { }\n\t\t}\n\t}\n}\n",
    "titles/b.txt": "c_y = {\n\tcapital = b_q\n}\n",
    "loc/a.yml": '\ufeffl_english:\n # note\n k_x:0 "Old"\n k_y: "say \\"hi\\"" # c\nbroken\n',
    "loc/b.yml": 'l_english:\n k_x:2 "New"\n',
    "faith/a.txt": "r_1 = { family = f faiths = { f_1 = { color = x } f_2 = { } } }",
    "house/a.txt": "h_1 = { dynasty = 2 }\nh_2 = { dynasty = 9 }\nh_3 = { name = x }",
    "dynasty/a.txt": "2 = { name = d }\n3 = { }\n",
    "nick/a.txt": "nick_a = { is_bad = yes }\nnick_b = { }",
    "contract/a.txt": "t_1 = { obligation_levels = { low = { } high = { default = yes } } }",
}


@pytest.fixture
def tree(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    return lambda part, glob="*.txt": sf.files(spark, f"{tmp_path}/{part}", glob)


def test_titles_and_labels(tree):
    first = {r.title_id: (r.title_rank, r.parent_title_id, r.capital_title_id, r.path, r.declarations) for r in sf.landed_titles(tree("titles")).collect()}
    assert first["e_x"] == ("empire", None, "c_y", "a.txt", 1) and first["d_x"][1] == "k_x"
    assert first["c_y"] == ("county", "d_x", None, "a.txt", 2)
    assert {r.title_id: r.capital_title_id for r in sf.landed_titles(tree("titles"), True).collect()}["c_y"] == "b_q"
    rows = sf.localisation(tree("loc", "*.yml"))
    assert rows.where("localization_key is null").count() == 1
    assert {r.localization_key: (r.display_value, r.value_version) for r in sf.labels(tree("loc", "*.yml")).collect()} == {"k_x": ("New", 2), "k_y": ('say "hi"', None)}
    with pytest.raises(Exception, match="missing header"):
        sf.localisation(tree("titles")).collect()


def test_catalogs(tree):
    assert {(r.id, r.religion_id) for r in sf.faiths(tree("faith")).collect()} == {("f_1", "r_1"), ("f_2", "r_1")}
    houses, dynasties = sf.field(tree("house"), "dynasty"), sf.catalog(tree("dynasty"))
    assert {(r.id, r.value, r.n) for r in houses.collect()} == {("h_1", "2", 1), ("h_2", "9", 1), ("h_3", None, 0)}
    assert {r.subject for r in sf.unresolved(houses, "value", dynasties).collect()} == {"9", None}
    sf.require_none(sf.duplicates(dynasties))
    with pytest.raises(ValueError, match="duplicate id: 2"):
        sf.require_none(sf.duplicates(dynasties.union(dynasties.where("id = 2"))))
    assert {(r.id, r.is_bad, r.is_prefix) for r in sf.nicknames(tree("nick")).collect()} == {("nick_a", True, False), ("nick_b", False, False)}
    assert sorted((r.level_index, r.level_id, r.is_default) for r in sf.obligations(tree("contract")).collect()) == [(0, "low", False), (1, "high", True)]
    rows = sf.manifest(tree("dynasty"))
    assert sf.tree_digest(rows).first() == sf.tree_digest(rows.repartition(3)).first() != sf.tree_digest(sf.manifest(tree("nick"))).first()


def test_saves(spark):
    meta = 'meta_data={\n save_game_version=3 version="1.9" meta_date=867.1.1 meta_player_name="A" meta_title_name="B" meta_player_tier=2\n meta_main_portrait={ id=7 } dlcs={ "x" "y" } can_get_achievements=yes ironman=no\n}\n'
    body = "landed_titles={\n1={\n key=c_a\n holder=7\n}\n2={\n key=b_a\n holder=7\n}\n}\nliving={\n7={\n first_name=\"A\"\n culture=4 faith=5 dynasty_house=6\n landed_data={ domain={ 1 2 } realm_capital=2 }\n}\n}\nplayed_character={\n character=7\n}\n"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("gamestate", meta + body)
    files = spark.createDataFrame([("a", packed.getvalue()), ("b", b"no zip")], "path string, content binary")
    got = {r.path: r for r in saves.metadata(files).collect()}
    assert got["a"].player_character_id == 7 and got["a"].dlcs == ["x", "y"] and got["a"].can_get_achievements and not got["a"].ironman
    assert got["b"].error.startswith("BadZipFile")
    a = saves.identity(files).where("path = 'a'").first()
    assert (a.error, a.primary_title_id, a.realm_capital_title_id, a.domain_title_ids, a.culture_id) == (None, "c_a", "b_a", ["c_a", "b_a"], 4)


def test_html_tables(spark):
    row = "<tr>" + "".join(f"<td>{x}</td>" for x in ["", *"abcdefghijklmno", "d_z"]) + "</tr>"
    html = f"<h2>Other</h2><table>{row}</table><h2><span>De jure duchies</span></h2><table><tr><th>Duchy</th></tr>{row}</table><h2>Uncreatable duchies</h2><table>{row}</table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.id, r.duchy_name, r.duchy_id) for r in html_tables.duchies(pages, "page_id", "html").collect()] == [("1", "a", "d_z")]


def test_sinks_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "owner string, v int")
    for change, want in (
        (commits.Change(rows, ("owner",)), {("a", 1), ("b", 2)}),
        (commits.Change(rows.where("owner = 'a'").selectExpr("owner", "v + 10 AS v"), ("owner",)), {("a", 11), ("b", 2)}),
        (commits.Change(rows.limit(0), ("owner",), rows.where("owner = 'a'")), {("b", 2)}),
        (commits.Change(rows.where("owner = 'a'")), {("a", 1), ("b", 2)}),
    ):
        commits.commit(spark, f"{tmp_path}/slices", {"t": change})
        assert {(r.owner, r.v) for r in commits.read(spark, f"{tmp_path}/slices", "t", "owner string, v int").collect()} == want
    more = spark.createDataFrame([("b", 9), ("c", 3)], "owner string, v int")
    for overwrite, want in ((True, 9), (False, 2)):
        path = f"{tmp_path}/keyed{overwrite}"
        sinks.upsert(rows, path, ["owner"])
        sinks.upsert(more, path, ["owner"], overwrite)
        assert {(r.owner, r.v) for r in sinks.read_version(spark, path).collect()} == {("a", 1), ("b", want), ("c", 3)}
    for _ in range(3):
        sinks.publish(rows, f"{tmp_path}/versions")
    assert len(sinks.versions(spark, f"{tmp_path}/versions")) == sinks.KEPT and sinks.read_version(spark, f"{tmp_path}/versions").count() == 2
    first = sinks.versions
    try:
        # Another writer that knew as much publishes first.
        stale = first(spark, f"{tmp_path}/versions")[:1]
        sinks.versions = lambda *x: stale
        with pytest.raises(RuntimeError, match="another writer"):
            sinks.publish(rows, f"{tmp_path}/versions")
    finally:
        sinks.versions = first
    assert sinks.read_version(spark, f"{tmp_path}/versions").count() == 2
    schema = "id long, key string, at timestamp, v int"
    for batch in ([(1, "x", "2024-01-02", 1), (1, "x", "2024-01-02", 1)], [(2, "x", "2024-01-03", 2), (3, "x", "2024-01-01", 3), (4, "y", "2024-01-01", 4)]):
        spark.createDataFrame(batch, "id long, key string, at string, v int").selectExpr("id", "key", "cast(at AS timestamp) AS at", "v").write.mode("append").parquet(f"{tmp_path}/in")
        observations.keep_latest(observations.observed(spark, f"{tmp_path}/in", schema), "key", "id", "at", f"{tmp_path}/latest", f"{tmp_path}/state", "30 days").awaitTermination()
    assert {(r.key, r.v) for r in observations.latest(spark, f"{tmp_path}/latest", schema).collect()} == {("x", 2), ("y", 4)}


def test_commits_show_all_tables_or_none(spark, tmp_path):
    path, schema = f"{tmp_path}/tables", "k string, v int"
    rows = lambda *x: commits.Change(spark.createDataFrame(x, schema))
    shown = lambda: {t: sorted(tuple(r) for r in commits.read(spark, path, t, schema).collect()) for t in "ab"}
    assert shown() == {"a": [], "b": []}
    commits.commit(spark, path, {"a": rows(("x", 1)), "b": rows(("x", 1))})
    before = {"a": [("x", 1)], "b": [("x", 1)]}
    broken = spark.range(1).selectExpr("'y' AS k", "CAST(raise_error('lost') AS int) AS v")
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, path, {"a": rows(("y", 2)), "b": commits.Change(broken)})
    assert shown() == before and len(os.listdir(path)) == 2

    def meanwhile(read):
        commits.commit(spark, path, {"a": rows(("z", 3))})

    with pytest.raises(RuntimeError, match="another writer"):
        commits.commit(spark, path, {"a": rows(("y", 2)), "b": rows(("y", 2))}, meanwhile)
    assert shown() == {"a": [("x", 1), ("z", 3)], "b": [("x", 1)]}

    def refuse(read):
        if read("a", schema).where("k = 'x'").count():
            raise ValueError("x is there")

    with pytest.raises(ValueError, match="x is there"):
        commits.commit(spark, path, {"a": rows(("x", 5))}, refuse)
    # Null owners have slices of their own; what old manifests alone named is removed.
    for v in range(4):
        commits.commit(spark, path, {"b": commits.Change(spark.createDataFrame([(None, v)], schema), ("k",))})
    assert {(r.k, r.v) for r in commits.read(spark, path, "b", schema).collect()} == {("x", 1), (None, 3)}
    assert len(sinks.versions(spark, path)) == sinks.KEPT


def test_a_saved_table_follows_its_files(spark, tmp_path):
    for k in (1, 2):
        spark.range(k).write.parquet(f"{tmp_path}/in{k}")
    try:
        for k in (1, 1, 2, 1):
            assert sinks.saved_once(spark, f"{tmp_path}/in{k}", "annalist_follow", f"{tmp_path}/table").count() == k
    finally:
        spark.sql("DROP TABLE IF EXISTS annalist_follow")
