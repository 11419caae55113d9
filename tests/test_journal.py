"""Journal requests: what passes, what is refused and why."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from annalist.operators import journal
from annalist.plans import catalogue

BASE = [("b_1", "c_1", "d_1", 1, "occupied", "castle", True, False), ("b_2", "c_1", "d_1", 2, "open", "empty", False, True), ("b_3", "c_2", "d_1", 1, "occupied", "city", True, False)]
BASE_SCHEMA = "barony_id string, county_id string, duchy_id string, slot_number long, slot_status string, holding_type string, is_county_capital boolean, is_open_barony_slot boolean"


def test_journal(spark):
    base = spark.createDataFrame(BASE, BASE_SCHEMA)
    lifecycle = spark.createDataFrame([("p", "c_2", False)], "playthrough_id string, county_id string, active_in_editor boolean")
    wanted = [("p", "b_1", "ruler", 1.0, " 867.1.1 "), ("p", "b_2", "ruler", None, "867.1.1"), ("p", "b_3", "vassal", None, "867.1.1"), ("p", "b_9", "x", -1.0, " "), ("p", "b_1", None, None, "867.1.1")]
    requests = spark.createDataFrame([(p, b, h, t, None, None, None, d, "manual") for p, b, h, t, d in wanted], "playthrough_id string, barony_id string, holder_type string, tax double, levies double, plague_resistance double, note string, observed_at string, source string")
    good, bad = journal.barony_observations(requests, base, lifecycle)
    assert [(r.barony_id, r.barony_name, r.observed_at, r.holding_type) for r in good.collect()] == [("b_1", "b_1", "867.1.1", "castle")]
    reasons = sorted(r.reasons for r in bad.collect())
    assert reasons == ["Cannot observe inactive county: c_2", "Cannot observe open barony slot: b_2", "Unknown barony: b_9; holder_type must be 'ruler' or 'vassal'; game_date is required; tax cannot be negative", "holder_type must be 'ruler' or 'vassal'"]
    assert journal.observation_events(good, "barony").first().event_type == "barony_observation_recorded"
    counties = spark.createDataFrame([("p", "c_1", 100.0, 1.0, 0.0, None, "d", "s"), ("p", "c_1", 101.0, None, 0.0, None, "d", "s")], "playthrough_id string, county_id string, control double, development double, popular_opinion double, note string, observed_at string, source string")
    good, bad = journal.county_observations(counties, base, lifecycle)
    assert good.count() == 1 and [r.reasons for r in bad.collect()] == ["development cannot be negative or empty; control cannot exceed 100"]
    moves = spark.createDataFrame([("p", "c_1", "acquired", "domain", "ruler", "1"), ("p", "c_1", "lost", None, None, "2"), ("p", "c_1", "reclaimed", "realm", "vassal", "3"), ("p", "c_2", "lost", None, None, "4"), ("p", "c_7", "acquired", "all", "ruler", "5")], "playthrough_id string, county_id string, event string, ownership_scope string, holder_type string, observed_at string")
    events, states, bad = journal.acquisitions(moves, base)
    assert {(r.event_id, r.ownership_scope, r.holder_type) for r in events.collect()} == {("p:c_1:acquired", "domain", "ruler"), ("p:c_1:lost", "realm", "unknown"), ("p:c_1:reclaimed", "realm", "vassal"), ("p:c_2:lost", "realm", "unknown")}
    assert states.count() == 4 and [r.reasons for r in bad.collect()] == ["ownership_scope must be 'domain' or 'realm'; Unknown base county: c_7"]
    assert {(r.county_id, r.lifecycle_state, r.active_in_editor) for r in journal.lifecycle_changes(events).collect()} == {("c_1", "active", True), ("c_2", "archived", False)}
    baselines = spark.createDataFrame([("b", "s", "0867-01-01")], "baseline_id string, reference_snapshot_id string, baseline_date string")
    chains = spark.createDataFrame([("b", "c_1", "d_1")], "baseline_id string, starting_title_id string, duchy string")
    runs = spark.createDataFrame([("p", "s", "b", "c_1", " A ", "m"), ("q", "s", "z", "c_1", "A", "m"), ("r", "s", "b", "c_9", "", "m")], "playthrough_id string, reference_snapshot_id string, baseline_id string, starting_title_id string, ruler_name string, source string")
    good, bad = journal.playthroughs(runs, baselines, chains)
    assert [(r.playthrough_id, r.ruler_name, r.duchy, r.lifecycle_state) for r in good.collect()] == [("p", "A", "d_1", "active")]
    assert {r.reasons for r in bad.collect()} == {"Baseline is not promoted for the selected reference snapshot", "ruler_name is required; Unknown title: c_9"}


def test_states_of_a_large_county_are_dealt(spark):
    """Gains of one file and one county, whose slots fill several blocks: many tasks make the product, each pair once, however it is joined."""
    n = 2 * journal.BLOCK + 5
    base = spark.range(n).selectExpr("concat('b_', id) AS barony_id", "'c_1' AS county_id", "'d_1' AS duchy_id", "id AS slot_number", "'open' AS slot_status", "'castle' AS holding_type", "id = 0 AS is_county_capital", "true AS is_open_barony_slot")
    moves = spark.range(64).selectExpr("concat('p', id) AS playthrough_id", "'c_1' AS county_id", "CASE WHEN id < 60 THEN 'acquired' ELSE 'lost' END AS event", "'domain' AS ownership_scope", "'ruler' AS holder_type", "'1' AS observed_at").coalesce(1)
    pairs = lambda: journal.acquisitions(moves, base)[1].select("acquisition_event_id", "barony_id")
    made = [r["count"] for r in pairs().groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 60 * n and max(made) <= 60 * n // 4
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pairs().agg(F.count("*").alias("n"), F.count_distinct("acquisition_event_id", "barony_id").alias("pairs")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert (got.n, got.pairs) == (60 * n, 60 * n)


def test_barony_states_are_dealt_and_equal_the_sql(spark, sf_dir):
    frame = catalogue.QUERIES["D39_barony_states"](spark, sf_dir)
    made = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    assert max(made) <= sum(made) // 4
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, frame.collect())) == sorted(con.execute(f"select {', '.join(frame.columns)} from ({catalogue.ORACLES['D39_barony_states']})").fetchall())
