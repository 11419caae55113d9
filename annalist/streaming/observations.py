"""A stream of observations to the latest one of each key. An extension: late and repeated rows are dealt with by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.operators import replay
from annalist.sources import sinks


def observed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def keep_latest(stream: DataFrame, key: str, event_id: str, at: str, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Each batch's newest rows win over what is published if they are newer; a batch that runs again changes nothing.

    What is published lies in buckets by the key's hash: a batch reads and writes only the buckets of its keys, and readers see all of them or none.
    """
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([event_id])
    schema = stream.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def merge(batch: DataFrame, number: int) -> None:
        new = replay.latest(batch, [key], [F.desc(at), F.desc(event_id)]).persist()
        # At most BUCKETS numbers.
        touched = {r[0] for r in new.select(sinks.bucket_of(key)).distinct().collect()}
        if touched:
            held = sinks.read_buckets(batch.sparkSession, path, schema.replace(":", " "), touched)
            sinks.publish_buckets(replay.latest(held.unionByName(new), [key], [F.desc(at), F.desc(event_id)]), path, key)
        new.unpersist()

    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is published."""
    return sinks.read_buckets(spark, path, schema)
