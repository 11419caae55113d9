"""What chains of odd titles leave on disk."""

from __future__ import annotations

import glob
import time

from pyspark.sql import functions as F

from annalist.operators import hierarchy, pointers
from annalist.session import shared_folder, written


def shuffled(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(k).getName() for k in range(files.size()))


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    table = written(spark, spark.range(1000).repartition(4, "id"), "dealt")
    for _ in range(50):
        if shuffled(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffled(spark) <= before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_validation_carries_rank_letters(spark, monkeypatch):
    """Baronies in a row under a county that leads nowhere, and a circle: no round's table holds the ids of a way; the nodes' table goes."""
    kinds, plain = [], pointers.written
    monkeypatch.setattr(pointers, "written", lambda s, frame, name: kinds.append(dict(frame.dtypes)["along"]) or plain(s, frame, name))
    rows = [(f"b_{k}", f"b_{k + 1}" if k < 9 else "c_gone", k) for k in range(10)] + [("c_a", "c_b", 20), ("c_b", "c_a", 21), ("e_a", None, 22), ("k_a", "e_a", 23), ("d_a", "e_a", 24)]
    got = {r.title_id: r.warning for r in hierarchy.validated(spark.createDataFrame(rows, "title_id string, parent_title_id string, source_order long")).collect()}
    assert kinds and set(kinds) == {"string"}
    assert got == {f"b_{k}": "missing parent title: c_gone" for k in range(10)} | {"c_a": "cyclic parent hierarchy", "c_b": "cyclic parent hierarchy", "e_a": None, "k_a": None, "d_a": "non-canonical rank chain: de"}
    held = f"{shared_folder(spark)}/annalist-{spark.sparkContext.applicationId}/titles-*".removeprefix("file:")
    assert not glob.glob(held)


def test_paths_of_ids_and_of_letters_agree(spark):
    rows = [(f"b_{k}", f"b_{k + 1}" if k < 9 else "c_a") for k in range(10)] + [("c_a", "d_a"), ("d_a", "c_z"), ("c_z", None)]
    nodes = spark.createDataFrame(rows, "title_id string, parent_title_id string")
    ids = {r.title_id: "".join(x[0] for x in r.path) for r in hierarchy.chains(nodes).where(~F.col("cyclic")).collect()}
    assert ids == {r.title_id: r.path for r in hierarchy.chains(nodes, letters=True).where(~F.col("cyclic")).collect()} and ids["b_0"] == "b" * 9 + "cdc"
