"""Sessions and settings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session of this machine alone, for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("annalist").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is set on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/annalist-shared")
        found = spark.sparkContext.getCheckpointDir()
    return found


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each run inside go when it ends; else they stay until the driver collects its garbage, over all rounds of a loop."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the frame as a table in the shared folder, which goes when the application ends. Lost executors cost the tasks they had."""
    path = f"{shared_folder(spark)}/annalist-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    with tidied(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(frame: DataFrame) -> None:
    """Remove the files of a table that `written` made and nothing reads any more."""
    path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.inputFiles()[0]).getParent() if frame.inputFiles() else None
    if path is not None:
        path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
