"""Sinks: appends, keyed replacement published as a new version, updates from another table, and CSV.

Readers never see half a write: a version is written whole and then pointed to. A pointer is a folder named by its number, created only if
it doesn't exist, so of two writers that start from the same version one fails and has to read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import replay

#: Versions that stay when a new one is published; buckets of a table that is replaced bucket by bucket.
KEPT, BUCKETS = 2, 64


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def path_of(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def files_of(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of each published version."""
    folder = path_of(spark, f"{path}/pointers")
    files = files_of(spark, folder)
    if not files.exists(folder):
        return []
    out = []
    for entry in files.listStatus(folder):
        number = entry.getPath().getName()
        out.append((int(number), files.listStatus(entry.getPath())[0].getPath().getName()))
    return sorted(out)


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The version that is pointed to last, None before the first."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/{known[-1][1]}") if known else None


def point(spark: SparkSession, path: str, version: str, known: list[tuple[int, str]]) -> None:
    """Name a written version as the next one; RuntimeError if another writer was first, and the version is removed."""
    number = known[-1][0] + 1 if known else 0
    made, taken = path_of(spark, f"{path}/.new-{version}"), path_of(spark, f"{path}/pointers/{number:012d}")
    files = files_of(spark, made)
    files.mkdirs(path_of(spark, f"{path}/.new-{version}/{version}"))
    files.mkdirs(path_of(spark, f"{path}/pointers"))
    # A rename to a folder that exists would put the source into it, so that is looked for as well.
    if files.exists(taken) or not files.rename(made, taken):
        files.delete(made, True)
        files.delete(path_of(spark, f"{path}/{version}"), True)
        raise RuntimeError(f"another writer published version {number}")


def forget(spark: SparkSession, path: str, names: list[str], pointers: list[int]) -> None:
    files = files_of(spark, path_of(spark, path))
    for number in pointers:
        files.delete(path_of(spark, f"{path}/pointers/{number:012d}"), True)
    for name in names:
        files.delete(path_of(spark, f"{path}/{name}"), True)


def publish(rows: DataFrame, path: str) -> None:
    """Write rows as a new version, then point to it; versions before the KEPT last ones are removed."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    known = versions(spark, path)
    rows.write.parquet(f"{path}/{version}")
    point(spark, path, version, known)
    old = known[: max(0, len(known) + 1 - KEPT)]
    forget(spark, path, [name for _, name in old], [number for number, _ in old])


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _parts(spark: SparkSession, path: str, version: str) -> dict[int, str]:
    """Which version holds each bucket: BUCKETS rows at most."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/{version}/parts").collect()}


def read_buckets(spark: SparkSession, path: str, schema: str, wanted: set[int] | None = None) -> DataFrame:
    """The rows that are pointed to last, of all buckets or those wanted."""
    known = versions(spark, path)
    parts = _parts(spark, path, known[-1][1]) if known else {}
    folders = [f"{path}/{v}/data/_bucket={b}" for b, v in sorted(parts.items()) if wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def publish_buckets(rows: DataFrame, path: str, key: str) -> None:
    """Replace the buckets of rows by rows and point to the whole; buckets without rows stay as they were written before."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    known = versions(spark, path)
    rows.withColumn("_bucket", bucket_of(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{version}/data")
    data = path_of(spark, f"{path}/{version}/data")
    touched = [int(f.getPath().getName().split("=")[1]) for f in files_of(spark, data).listStatus(data) if f.getPath().getName().startswith("_bucket=")]
    parts = (_parts(spark, path, known[-1][1]) if known else {}) | dict.fromkeys(touched, version)
    spark.createDataFrame(sorted(parts.items()), "bucket int, version string").coalesce(1).write.parquet(f"{path}/{version}/parts")
    point(spark, path, version, known)
    old = known[: max(0, len(known) + 1 - KEPT)]
    held = set(parts.values()) | {v for _, name in known[len(old) :] for v in _parts(spark, path, name).values()}
    forget(spark, path, [name for _, name in old if name not in held], [number for number, _ in old])


def upsert(rows: DataFrame, path: str, keys: list[str], overwrite: bool = True) -> None:
    """Keyed replacement; without overwrite, rows of known keys are left alone."""
    held = read_version(rows.sparkSession, path)
    if held is None:
        publish(rows, path)
    else:
        publish(replay.keyed_replace(held, rows, keys) if overwrite else replay.keyed_replace(rows, held, keys), path)


def updated(rows: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with columns set from the source's row of the same keys (unique there), where there is one; a null there is set too."""
    marked = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    out = rows.join(marked, keys, "left")
    return out.select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def table(spark: SparkSession, name: str, allowed: tuple[str, ...]) -> DataFrame:
    """A table of the catalog, if its name is one of those allowed."""
    if name not in allowed:
        raise ValueError(f"unknown table: {name}")
    return spark.table(name)


def saved_once(spark: SparkSession, path: str, name: str, location: str) -> DataFrame:
    """The table of that name, made at a location from Parquet files if it isn't there yet or was made from other files."""
    made_from = None
    if spark.catalog.tableExists(name):
        made_from = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get("made_from")
    if made_from != path:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.read.parquet(path).write.mode("overwrite").option("path", location).saveAsTable(name)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('made_from' = '{path}')")
    return spark.table(name)


def columns_of(spark: SparkSession, name: str) -> list[str]:
    """The columns of a table by the catalog, none if there is no such table."""
    return [c.name for c in spark.catalog.listColumns(name)] if spark.catalog.tableExists(name) else []


def csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """With a header; as one file for a small report."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", "true").csv(path)
