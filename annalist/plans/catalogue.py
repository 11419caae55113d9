"""The driver catalogue: queries of the engine's own operators with their SQL twins.

Relational forms are here; `domain` holds replay, classification, readiness and summaries over adapted tables, `scripts` what is read from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import script
from annalist.operators import hierarchy, replay
from annalist.plans.registry import CUTOFF, OPS, ORACLES, QUERIES, TABLES, TITLES, dealt, operations, own, shared, titles
from annalist.sources import script_files

__all__ = ["ORACLES", "QUERIES", "TABLES"]

@own("D6_state_replay", f"""SELECT user_id, nullif(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'signup'), '0') AS holder, nullif(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view'), '0') AS liege,
nullif(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click'), '0') AS government, CAST(sum(CAST(value AS bigint)) FILTER (WHERE event_type = 'purchase') AS bigint) AS development, CAST(0 AS bigint) AS development_unknown
FROM ({OPS}) WHERE ts <= {CUTOFF} GROUP BY user_id""")
def state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = F.col("ts") <= F.expr(CUTOFF.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    return replay.state(operations(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "value", {"holder": "signup", "liege": "view", "government": "click"}, {"development": "purchase"}, cutoff)


@own("A15_set_replacement", f"SELECT user_id, string_agg(value, ',' ORDER BY ts, event_id) AS kept FROM (SELECT *, max(CASE WHEN value = '0' THEN event_id END) OVER (PARTITION BY user_id) AS cleared FROM ({OPS}) WHERE event_type = 'signup') WHERE cleared IS NULL OR event_id > cleared GROUP BY user_id")
def set_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left since the last clear. The result itself is one row an entity that holds its list, as a title holds its laws: lists are small here."""
    ops = operations(spark, sf_dir).where("event_type = 'signup'").withColumn("cleared", F.max(F.when(F.col("value") == "0", F.col("event_id"))).over(Window.partitionBy("user_id")))
    held = ops.where("cleared is null or event_id > cleared")
    return held.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]), ",").alias("kept"))


@own("J13_asof_holder", f"SELECT event_id, user_id, nullif(holder, '0') AS holder FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM ({OPS})) WHERE event_type = 'error'")
def asof_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir).where("event_type in ('signup', 'error')")
    held = ops.withColumn("holder", replay.in_force(ops, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("value"))))
    return held.where("event_type = 'error'").select("event_id", "user_id", F.nullif("holder", F.lit("0")).alias("holder"))


@own("D1_validate_hierarchy", f"""WITH t AS ({TITLES}), n AS (SELECT title_id, min(parent_title_id) AS parent_title_id, count(*) AS n FROM t GROUP BY title_id),
c AS (SELECT a.title_id, a.n, a.parent_title_id p1, b.parent_title_id p2, c.parent_title_id p3, d.parent_title_id p4, e.parent_title_id p5,
coalesce(CASE WHEN a.parent_title_id IS NOT NULL AND b.title_id IS NULL THEN a.parent_title_id END, CASE WHEN b.parent_title_id IS NOT NULL AND c.title_id IS NULL THEN b.parent_title_id END, CASE WHEN c.parent_title_id IS NOT NULL AND d.title_id IS NULL THEN c.parent_title_id END, CASE WHEN d.parent_title_id IS NOT NULL AND e.title_id IS NULL THEN d.parent_title_id END) AS missing
FROM n a LEFT JOIN n b ON a.parent_title_id = b.title_id LEFT JOIN n c ON b.parent_title_id = c.title_id LEFT JOIN n d ON c.parent_title_id = d.title_id LEFT JOIN n e ON d.parent_title_id = e.title_id),
r AS (SELECT *, concat(title_id[1], coalesce(p1[1], ''), coalesce(p2[1], ''), coalesce(p3[1], ''), coalesce(p4[1], ''), coalesce(p5[1], '')) AS ranks FROM c),
w AS (SELECT title_id, CASE WHEN n > 1 THEN 'duplicate title declarations' WHEN missing IS NOT NULL THEN concat('missing parent title: ', missing) WHEN ranks <> substring('bcdke', instr('bcdke', title_id[1])) THEN concat('non-canonical rank chain: ', ranks) END AS warning FROM r)
SELECT title_id, warning IS NULL AS selectable, warning FROM w""")
def validate_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.validated(titles(spark, sf_dir))


@own("D2_static_capital", f"WITH t AS ({TITLES}) SELECT parent_title_id AS title_id, arg_min(title_id, source_order) AS capital_id FROM t WHERE title_id LIKE 'b%' GROUP BY parent_title_id")
def static_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.first_child(titles(spark, sf_dir).where("title_id like 'b%'"), "source_order")


@own("D45_flatten", f"""WITH t AS (SELECT title_id, max(parent_title_id) AS parent_title_id, min(source_order) AS source_order FROM ({TITLES}) GROUP BY title_id),
x AS (SELECT a.title_id AS barony, b.title_id AS county, c.title_id AS duchy, d.title_id AS kingdom, e.title_id AS empire, a.source_order FROM t a JOIN t b ON a.parent_title_id = b.title_id JOIN t c ON b.parent_title_id = c.title_id LEFT JOIN t d ON c.parent_title_id = d.title_id LEFT JOIN t e ON d.parent_title_id = e.title_id WHERE a.title_id LIKE 'b%')
SELECT barony, county, duchy, kingdom, empire, row_number() OVER (PARTITION BY county ORDER BY source_order, barony) = 1 AS is_county_capital FROM x""")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.flattened(titles(spark, sf_dir))


@own("W3_D41_overlay", "SELECT c_custkey, coalesce(o.v, c_acctbal) AS metric FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def observed_over_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_acctbal").alias("metric"))
    seen = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("metric"), "o_orderdate", "o_orderkey")
    return replay.overlay(base, replay.latest(seen, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]), "c_custkey", ["metric"])


@own("K6_keyed_replace", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 5 = 0")
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return replay.keyed_replace(base, base.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


shared("J4_literal_in_on", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA'")
shared("J5_unresolved_ids", "SELECT count(DISTINCT d.doc_id) AS unresolved FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
shared("J6_U2_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
shared("U3_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
shared("J7_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
shared("J8_self_join", "SELECT DISTINCT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
shared("J15_lookup_default", "SELECT p_partkey, coalesce(s_name, 'unobserved') AS seen FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
shared("A1_A3_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS customers FROM orders")
shared("A4_group_all", "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) FILTER (WHERE c_acctbal < 0) AS indebted FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
shared("A5_group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
shared("W1_latest_run", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1")
shared("W4_sequence", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
shared("W5_first_grant", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) x WHERE r = 1")
shared("A18_label_winner", "SELECT k, text, CASE WHEN n = 1 THEN 'valid' WHEN d = 1 THEN 'identical_duplicate' ELSE 'review_required' END AS status FROM (SELECT concat(conv_id, ':', role) AS k, text, count(*) OVER (PARTITION BY conv_id, role) AS n, CASE WHEN min(text) OVER (PARTITION BY conv_id, role) = max(text) OVER (PARTITION BY conv_id, role) THEN 1 ELSE 2 END AS d, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS r FROM conversations) x WHERE r = 1")
shared("A20_semantic_hash", "SELECT conv_id, sha2(concat_ws('\n', array_sort(collect_list(text))), 256) AS digest FROM conversations GROUP BY conv_id", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY text)) AS digest FROM conversations GROUP BY conv_id")
shared("M2_manifest", "SELECT doc_id, sha2(text, 256) AS sha256, length(text) AS chars FROM documents", "SELECT doc_id, sha256(text) AS sha256, length(text) AS chars FROM documents")
shared("P3_selector_search", "SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%RING%' OR p_brand ILIKE '%RING%') AND p_size > 5")
shared("P4_like", "SELECT doc_id FROM documents WHERE text LIKE 'The %' OR text LIKE '%token%'")
shared("P5_in_list", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3) GROUP BY event_type")
shared("P6_list_param", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT explode(array(1, 2, 3, 5, 8, 13)))", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT unnest([1, 2, 3, 5, 8, 13]))")
shared("P7_tuple_in", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1 AND l_returnflag = 'R')")
shared("P9_try_cast", "SELECT o_orderkey FROM orders WHERE coalesce(try_cast(concat('1995-', o_orderkey % 14, '-30') AS date), DATE '0001-01-01') <= DATE '1995-06-30'")
shared("T2_latest_one", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
shared("T3_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
shared("T5_custom_order", "SELECT n_name, CASE n_regionkey WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS place FROM nation ORDER BY place, n_name NULLS LAST")
shared("F11_squeeze", r"SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ')) AS squeezed FROM documents", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS squeezed FROM documents")
shared("F14_strip_prefix", "SELECT c_custkey, regexp_replace(c_name, '^Customer#0*', '') AS bare FROM customer")
shared("D47_options", "SELECT concat(c_name, CASE WHEN c_acctbal < 0 THEN ' (warning)' ELSE '' END) AS label, c_custkey AS value FROM customer")


@own("T1_children", f"SELECT parent_title_id, title_id, row_number() OVER (PARTITION BY parent_title_id ORDER BY source_order, title_id) AS position FROM ({TITLES}) t WHERE parent_title_id LIKE 'k_%'")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("parent_title_id").orderBy("source_order", "title_id"))
    return titles(spark, sf_dir).where("parent_title_id LIKE 'k_%'").select("parent_title_id", "title_id", rank.alias("position"))


@own("D46_partial_update", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of nothing leaves a name, a change of the balance isn't allowed."""
    base = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    change = base.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit("NONE").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return replay.overlay(base, change, "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"], fixed=("c_acctbal",), insert=False)


def script_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history file for each part: a static name and a dated block."""
    text = F.format_string('p_%d = { name = "%s" # note {\n 867.1.%d = { holder = %d } }', "p_partkey", "p_name", F.col("p_size") % 28 + 1, "p_partkey")
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.format_string("%d.txt", "p_partkey").alias("path"), F.encode(text, "UTF-8").alias("content"))


@own("S3_script_history", """SELECT concat(p_partkey, '.txt') AS path, concat('p_', p_partkey) AS entity_id, 0 AS declaration_order, CAST(NULL AS integer) AS effective_date, 'name' AS operation_key, p_name AS raw_value FROM part
UNION ALL SELECT concat(p_partkey, '.txt'), concat('p_', p_partkey), 1, 8670100 + p_size % 28 + 1, 'holder', CAST(p_partkey AS varchar) FROM part""")
def script_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.history(script_of_parts(spark, sf_dir)).select("path", "entity_id", "declaration_order", "effective_date", "operation_key", "raw_value")


@own("F1_script_declarations", """SELECT concat('p_', p_partkey) AS keys, 'block' AS kind, CAST(NULL AS varchar) AS scalar_value, 1 AS line_start, 2 AS line_end FROM part
UNION ALL SELECT concat('p_', p_partkey, '/name'), 'scalar', p_name, 1, 1 FROM part
UNION ALL SELECT concat('p_', p_partkey, '/867.1.', p_size % 28 + 1), 'block', NULL, 2, 2 FROM part
UNION ALL SELECT concat('p_', p_partkey, '/867.1.', p_size % 28 + 1, '/holder'), 'scalar', CAST(p_partkey AS varchar), 2, 2 FROM part""")
def script_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = script_files.declarations(script_of_parts(spark, sf_dir), 3)
    return rows.select(F.array_join("keys", "/").alias("keys"), "kind", F.when(F.col("kind") == "scalar", F.col("value")).alias("scalar_value"), "line_start", "line_end")


from annalist.plans import domain, scripts  # noqa: E402, F401  (they register their queries)
