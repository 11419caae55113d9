"""The ordered fold, the table functions over script bodies, and the one parse that title events are made from."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from annalist.functions import readings
from annalist.operators import folds, title_events

ORDER = ["at", "step"]


def events(seed: int) -> list[tuple]:
    """(key, at, step, value, starts): lists that replace, empty lists, and single values that append."""
    rng, out = random.Random(seed), []
    for key in ("a", "b", "c"):
        for at in range(40):
            kind = rng.randrange(5)
            if kind == 0:
                ids = rng.sample("pqrst", rng.randrange(4))
                out += [(key, at, k, v, k == 0) for k, v in enumerate(ids or [None])]
            elif kind < 3:
                out.append((key, at, 0, rng.choice("pqrst"), False))
    return out


def walked(rows: list[tuple], until: int) -> dict[str, list[tuple]]:
    held: dict[str, list[tuple]] = {}
    for key, at, step, value, starts in sorted(rows, key=lambda r: r[:3]):
        if at >= until:
            continue
        if starts:
            held[key] = []
        if value is not None and value not in [v for v, _, _ in held.setdefault(key, [])]:
            held[key].append((value, at, step))
    return held


def test_sets_with_resets_and_appends(spark):
    rows = events(1)
    frame = spark.createDataFrame(rows, "key string, at int, step int, value string, starts boolean").repartition(3)
    got: dict[str, list[tuple]] = {}
    for r in folds.in_force(frame.where("at < 33"), "key", ORDER, F.col("starts")).orderBy("key", "position").collect():
        got.setdefault(r.key, []).append((r.value, r.at, r.step))
    assert got == {k: v for k, v in walked(rows, 33).items() if v}
    asked = spark.createDataFrame([(k, at, -1) for k in "abcd" for at in range(0, 45, 3)], "key string, at int, step int")
    for r in folds.at_instants(frame, asked, "key", ORDER).collect():
        assert r.held == [v for v, _, _ in walked(rows, r.at).get(r.key, [])], r


OPERATIONS = "title_id string, path string, effective_date int, declaration_order long, operation_key string, value_kind string, scalar_value string, raw_value string"


def test_bodies_are_parsed_once(spark, monkeypatch):
    rows = [("k_a", "a.txt", 8670101, 1, "effect", "block", None, "{ set_title_name = key_x }"), ("k_a", "a.txt", 8670102, 2, "holder", "scalar", "7", "7"), ("k_b", None, None, 3, "effect", "block", None, None)]
    plans = []
    plain = title_events.written
    monkeypatch.setattr(title_events, "written", lambda s, frame, name: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or plain(s, frame, name))
    found = title_events.read(spark.createDataFrame(rows, OPERATIONS))
    assert len(plans) == 1 and plans[0].count("PythonUDTF") == 1 and plans[0].count("Exchange hashpartitioning") == 1
    assert [(r.kind, r.value, r.operation_key) for r in found.said.collect()] == [("name", "key_x", "effect")]
    assert "Python" not in found.forms._jdf.queryExecution().executedPlan().toString()
    assert found.operations.count() == 3


def test_table_functions_on_odd_rows(spark):
    readings.register(spark)
    assert spark.sql("SELECT * FROM script_assignments(NULL, 1)").collect() == [] and spark.sql("SELECT * FROM script_assignments('', 1)").collect() == []
    assert [tuple(r) for r in spark.sql("SELECT * FROM script_assignments('# x = 1\na = { b = 1 }', 5)").collect()] == [(0, "a", "block", "{ b = 1 }", 6)]
    assert [r.readings for r in spark.sql("SELECT * FROM script_readings(NULL, NULL, NULL, NULL, NULL, NULL)").collect()] == [[]]
