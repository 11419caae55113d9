"""The catalogue's registry: queries, their SQL twins, and adapters that give driver tables the engine's shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Titles: region > nation > customer > order > line, with faults put in by rule.
TITLES = """SELECT concat('e_', r_regionkey) AS title_id, CAST(NULL AS varchar(40)) AS parent_title_id, r_name AS display_name, CAST(r_regionkey AS bigint) AS source_order FROM region
UNION ALL SELECT concat('k_', n_nationkey), concat('e_', n_regionkey), n_name, CAST(n_nationkey AS bigint) FROM nation
UNION ALL SELECT concat('d_', c_custkey), CASE WHEN c_custkey % 97 = 0 THEN 'e_0' WHEN c_custkey % 101 = 0 THEN 'k_999' ELSE concat('k_', c_nationkey) END, c_name, c_custkey FROM customer
UNION ALL SELECT concat('c_', o_orderkey), concat('d_', o_custkey), o_orderpriority, o_orderkey FROM orders
UNION ALL SELECT concat('b_', l_orderkey, '_', l_linenumber), concat('c_', l_orderkey), l_returnflag, l_orderkey * 10 + l_linenumber FROM lineitem"""
CUTOFF = "TIMESTAMP '2024-01-16 00:00:00'"


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


#: Words of shared SQL that each engine spells in its own way: (word, Spark, DuckDB).
DIALECT = (("JSON_K(props)", "CAST(get_json_object(props, '$.k') AS INT)", "CAST(props->>'k' AS INT)"),)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    views(spark, sf_dir, text)
    for word, own, _ in DIALECT:
        text = text.replace(word, own)
    return spark.sql(text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("varchar(40)", "string"))


def duck(text: str) -> str:
    """Shared SQL for DuckDB."""
    for word, _, own in DIALECT:
        text = text.replace(word, own)
    return text


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as a shuffle has: a small table's file is read by one task, which alone would then make and parse all files of its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(rows.columns[0]))


def day(column: str) -> str:
    """A date or timestamp as y * 10000 + m * 100 + d, in both engines."""
    return f"CAST(year({column}) * 10000 + month({column}) * 100 + day({column}) AS INT)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, TITLES)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").alias("v"), F.when(F.get_json_object("props", "$.k").cast("int") % 10 == 0, "0").otherwise(F.get_json_object("props", "$.k")).alias("value"))


#: The same operations for DuckDB.
OPS = "SELECT user_id, ts, event_id, event_type, CASE WHEN CAST(props->>'k' AS integer) % 10 = 0 THEN '0' ELSE props->>'k' END AS value FROM events"


def own(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return put


def shared(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose SQL both engines understand (or a twin where they don't)."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLES[name] = duck(oracle or text)


def line_sql(columns: list[str]) -> str:
    """The canonical text of some columns in DuckDB SQL."""
    return "concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in columns) + ")"


def tree_sql(rows: str, columns: list[str], key: list[str], by: list[str], digits: int) -> list[str]:
    """A hash tree's levels in DuckDB SQL, from the buckets to the roots."""
    groups = "".join(f"{c}, " for c in by)
    out = [f"SELECT {groups}substring(sha256({line_sql(key)}), 1, {digits}) AS prefix, count(*) AS n, sha256(string_agg(sha256({line_sql(sorted(columns))}), ',' ORDER BY sha256({line_sql(sorted(columns))}))) AS sha256 FROM ({rows}) r GROUP BY ALL"]
    while digits:
        digits = max(0, digits - 2)
        out.append(f"SELECT {groups}substring(p, 1, {digits}) AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(concat(p, ':', d), ',' ORDER BY concat(p, ':', d))) AS sha256 FROM (SELECT {groups}prefix AS p, n, sha256 AS d FROM ({out[-1]}) x) y GROUP BY ALL")
    return out
