"""Many small files: parsed in few frames by many tasks, and results beyond the width of a padded number."""

from __future__ import annotations

import glob

import duckdb

from annalist.functions import script
from annalist.operators import pointers
from annalist.plans import catalogue, scripts
from annalist.session import shared_folder
from annalist.sources import saves


def test_rows_of_many_files_share_frames():
    frames = list(script.framed(((f"{k}.txt", k) for k in range(20_000)), "path string, n int"))
    assert [len(f) for f in frames] == [8192, 8192, 3616] and list(frames[2].iloc[-1]) == ["19999.txt", 19_999]
    assert list(script.framed([], "path string")) == []


def test_files_of_parts_are_dealt(spark, sf_dir):
    assert catalogue.script_of_parts(spark, sf_dir).rdd.getNumPartitions() == 4


def test_saves_are_dealt_and_keep_errors_between_them(spark, sf_dir):
    files = scripts.save_files(spark, sf_dir)
    assert files.rdd.getNumPartitions() == 4
    got = {r.path: r.error for r in saves.metadata(files).collect()}
    assert len(got) == files.count() and all((got[p] is not None) == (int(p[1:-4]) % 7 == 0) for p in got)


def test_numbers_wider_than_their_padding(spark, tmp_path):
    """Keys of more digits than a file's name shows: paths as the SQL writes them, order by the whole number."""
    keys = [7, 10007, 99997, 100007, 999999, 1000007, 1999999]
    spark.createDataFrame([(k, k % 2) for k in keys], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"n{k}", "Brand#1", 3) for k in keys], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("S1_landed_titles", "S1_source_order", "S28_last_declarations", "S2_localisation", "S2_labels_in_force"):
        frame = catalogue.QUERIES[name](spark, str(tmp_path))
        cols = ", ".join(frame.columns)
        assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, con.execute(f"select {cols} from ({catalogue.ORACLES[name]})").fetchall())), name


def test_pointer_rounds_leave_one_table(spark):
    held = lambda: set(glob.glob(f"{shared_folder(spark)}/annalist-{spark.sparkContext.applicationId}/pointers-*".removeprefix("file:")))
    before = held()
    edges = spark.range(64).selectExpr("id AS node", "CASE WHEN id < 63 THEN id + 1 END AS next", "array(id) AS along").selectExpr("string(node) AS node", "string(next) AS next", "cast(along AS array<string>) AS along")
    assert {r.end for r in pointers.resolved(edges).collect()} == {"63"} and len(held() - before) == 1
