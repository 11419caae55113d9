"""Bodies of title operations: parsed by all tasks, once each, and without a frame for each row."""

from __future__ import annotations

import duckdb
import pytest

from annalist.functions import effects, readings, script
from annalist.operators import title_events
from annalist.plans import catalogue

QUERIES = ("D8_title_events", "D10_laws_in_force", "D13_name_overrides", "D14_title_variables", "D16_court_states", "D18_prestige_bounds", "D19_package_gates", "D9_resolution_status", "W6_laws_before_effects")


@pytest.mark.parametrize("name", QUERIES)
def test_operations_are_dealt_before_their_parse(spark, sf_dir, monkeypatch, name):
    """The tables' files are read by one task each; the result is that of the SQL."""
    plans, plain = [], title_events.written
    monkeypatch.setattr(title_events, "written", lambda s, frame, table: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or plain(s, frame, table))
    frame = catalogue.QUERIES[name](spark, sf_dir)
    assert len(plans) == 1 and "RoundRobinPartitioning(4)" in plans[0] and "BatchEvalPythonUDTF" in plans[0]
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wanted = con.execute(f"select {', '.join(frame.columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert wanted and sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, wanted))


def test_one_parse_serves_all_recognisers(monkeypatch):
    parsed, plain = [], script.assignments
    monkeypatch.setattr(script, "assignments", lambda text, line=1: parsed.append(text) or plain(text, line))
    raw = "{ set_title_name = parsed_once_key }"
    found = [x for f in effects.RECOGNISERS for x in f("effect", "block", raw)]
    assert found == [("name", None, "parsed_once_key", None, None)] and effects.said_whole(found, "effect", "block", raw)
    assert len(parsed) == 1


def test_readings_of_a_skewed_title_are_dealt(spark):
    rows = spark.range(400).coalesce(1).selectExpr("'k_a' AS title_id", "'a' AS path", "8670101 AS effective_date", "id AS declaration_order", "'effect' AS operation_key", "'block' AS value_kind", "concat('{ set_title_name = key_', id, ' }') AS raw_value")
    parts = [len(p) for p in readings.read(rows).rdd.glom().collect()]
    assert len(parts) == 4 and max(parts) < 200 and sum(parts) == 400
