"""A corpus pipeline of five stages; each reads what the one before kept, written as Parquet and read again.

Every stage but the last returns rows of `documents` with its columns. Defined results in all of them: an empty table gives an
empty table; other columns, whatever their names, stay as they are; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, decontamination, near_dedup, quality, secrets
from annalist.llm.common import documents, scratch
from annalist.llm.queries import RANKS_FILE, pattern, table, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go. The model learns from the rows it gets.

    Null and empty texts are scored as empty ones; repeated rows and null ids are judged row by row.
    """
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id.

    Texts without words are in no group and stay; of rows that repeat an id one stays; rows with a null id stay.
    """
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null and empty texts hold none; repeated rows and null ids are judged row by row."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows the text, null for a null text. No row goes."""
    return secrets.redact(docs, ranks_path=vocabulary(RANKS_FILE)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row; null and empty texts have none."""
    return bpe.encode(docs, vocabulary(RANKS_FILE), pattern()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encode", encode),
]

#: No stage is expressible in SQL; tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
