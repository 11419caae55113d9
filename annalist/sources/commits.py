"""Several tables changed by one commit: readers see all of it or nothing.

A commit writes its rows into a folder of its own, then a manifest that says which folder holds each slice of each table, then the pointer to it
(as in `sinks`: created only if it doesn't exist, so of two writers that start from the same version one fails, and its folder goes). An append
is a slice of its own; a replacement names the owners whose slices go, with or without new rows. What fails before the pointer leaves nothing to be seen.
Manifests are tables, changed by a join; only a listing of one table's slices passes the driver when it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources import sinks

MANIFEST = "table_name string, slice string, version string"


@dataclass
class Change:
    """Rows to append or, with an owner (columns), to put in place of the owners' slices. owners: which are replaced, those of the rows if not given."""

    rows: DataFrame
    owner: tuple[str, ...] = ()
    owners: DataFrame | None = None


def _slice(owner: tuple[str, ...]) -> Column:
    """A folder name for an owner's values, null ones too."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in owner])), 256)


def _manifest(spark: SparkSession, path: str, known: list[tuple[int, str]]) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/{known[-1][1]}/manifest") if known else spark.createDataFrame([], MANIFEST)


def _read(spark: SparkSession, path: str, table: str, schema: str, known: list[tuple[int, str]]) -> DataFrame:
    rows = _manifest(spark, path, known).where(F.col("table_name") == table).collect()
    folders = [f"{path}/{r.version}/{table}/_slice={r.slice}" for r in rows]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table as the last commit left it, empty before the first."""
    return _read(spark, path, table, schema, sinks.versions(spark, path))


def _written(spark: SparkSession, folder: str, rows: DataFrame) -> list[str]:
    """Write rows by _slice and list the slices. A slice of any size spreads over tasks: partitions are evened out, not dealt by slice."""
    rows.hint("rebalance").write.partitionBy("_slice").parquet(folder)
    held = sinks.path_of(spark, folder)
    return [f.getPath().getName().split("=", 1)[1] for f in sinks.files_of(spark, held).listStatus(held) if f.getPath().getName().startswith("_slice=")]


def commit(spark: SparkSession, path: str, changes: dict[str, Change], check: Callable[[Callable[[str, str], DataFrame]], None] | None = None) -> None:
    """Publish all changes at once. check: is given a reader (table, schema) of the version that the commit starts from, and raises to refuse it.

    RuntimeError if another writer published in between; then, and after any other failure, the tables are as they were.
    """
    known, version = sinks.versions(spark, path), uuid.uuid4().hex
    if check:
        check(lambda table, schema: _read(spark, path, table, schema, known))
    try:
        entries, gone = [], []
        for table, change in changes.items():
            name = _slice(change.owner) if change.owner else F.lit(version)
            entries += [(table, s, version) for s in _written(spark, f"{path}/{version}/{table}", change.rows.withColumn("_slice", name))]
            if change.owner:
                owners = change.rows if change.owners is None else change.owners
                gone.append(owners.select(F.lit(table).alias("table_name"), _slice(change.owner).alias("slice")).distinct())
        manifest = _manifest(spark, path, known)
        for owners in gone:
            manifest = manifest.join(owners, ["table_name", "slice"], "left_anti")
        fresh = spark.createDataFrame(entries, MANIFEST)
        manifest.select("table_name", "slice", "version").unionByName(fresh).coalesce(1).write.parquet(f"{path}/{version}/manifest")
        sinks.point(spark, path, version, known)
    except Exception:
        folder = sinks.path_of(spark, f"{path}/{version}")
        if version not in [name for _, name in sinks.versions(spark, path)]:
            sinks.files_of(spark, folder).delete(folder, True)
        raise
    old = known[: max(0, len(known) + 1 - sinks.KEPT)]
    kept = {version, *[name for _, name in known[len(old) :]]}
    used = {r.version for v in kept for r in spark.read.schema(MANIFEST).parquet(f"{path}/{v}/manifest").select("version").distinct().collect()}
    sinks.forget(spark, path, [name for _, name in old if name not in used], [number for number, _ in old])
