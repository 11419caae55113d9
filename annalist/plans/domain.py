"""Queries of the domain operators over adapted driver tables. Each adapter is shared SQL; each oracle states the rule again in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import baselines, classify, freeze, hierarchy, inspection, readiness, replay, states, summary, trees
from annalist.plans.registry import TITLES, day, own, run_sql, shared, titles, tree_sql
from annalist.sources import sinks

BASELINE = 20240116

# --- adapters: title histories from events

#: Operations of title histories: a user's events are one block; every thirteenth user's block is declared twice.
TITLE_OPS = f"""SELECT CASE WHEN user_id % 13 = 0 THEN concat('k_s', user_id) WHEN user_id % 7 = 0 THEN concat('k_u', user_id) ELSE concat('k_', user_id % 120) END AS title_id,
CAST(user_id + copy * 1000000 AS INT) AS block_order, concat('history/titles/', CASE WHEN user_id % 5 = 0 THEN 'z' ELSE 'a' END, user_id % 2, '.txt') AS source_path, {day("ts")} AS effective_date,
CAST(event_id + copy * 100000000 AS BIGINT) AS declaration_order,
CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'holder_ignore_head_of_faith_requirement' ELSE 'holder' END WHEN 'view' THEN 'liege' WHEN 'click' THEN 'government' WHEN 'purchase' THEN 'change_development_level' ELSE CASE WHEN event_id % 3 = 0 THEN 'effect' ELSE 'court' END END AS operation_key,
CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'some' WHEN JSON_K(props) % 10 = 0 THEN '0' ELSE concat('', JSON_K(props)) END AS scalar_value, event_id % 2 = 0 AS evaluated
FROM events JOIN (SELECT 0 AS copy UNION ALL SELECT 1) copies ON copy = 0 OR user_id % 13 = 0"""
_SAID = "concat(effective_date, '|', operation_key, '|', coalesce(scalar_value, ''))"


def title_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, TITLE_OPS)


def title_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ops = title_operations(spark, sf_dir)
    said = F.concat_ws("|", "effective_date", "operation_key", F.coalesce("scalar_value", F.lit("")))
    blocks = ops.groupBy("title_id", "block_order", "source_path").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(said))), 256).alias("semantic_sha256"))
    return ops, blocks


_TITLE_CLASSES = f"""ops AS ({TITLE_OPS}),
blocks AS (SELECT title_id, block_order, source_path, sha256(string_agg({_SAID}, chr(10) ORDER BY {_SAID})) AS h FROM ops GROUP BY ALL),
tops AS (SELECT title_id, count(*) AS n, count(DISTINCT h) AS hashes, count(DISTINCT source_path) AS paths, max(source_path) AS top FROM blocks GROUP BY title_id),
tips AS (SELECT b.title_id, count(*) AS at_top, max(block_order) AS winner FROM blocks b JOIN tops t ON b.title_id = t.title_id AND source_path = top GROUP BY b.title_id),
clash AS (SELECT title_id, effective_date, operation_key FROM ops WHERE operation_key IN ('holder', 'liege', 'government') AND scalar_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT scalar_value) > 1),
early AS (SELECT title_id, string_agg(DISTINCT operation_key, ',' ORDER BY operation_key) AS fields FROM clash WHERE effective_date <= {BASELINE} GROUP BY title_id),
late AS (SELECT DISTINCT title_id FROM clash WHERE effective_date > {BASELINE}),
classes AS (SELECT t.title_id, CASE WHEN n = 1 THEN 'unique' WHEN hashes = 1 THEN 'semantic_identical' WHEN fields IS NOT NULL AND paths > 1 AND at_top = 1 THEN 'resolved_by_source_order' WHEN fields IS NOT NULL THEN 'conflicting_at_baseline'
  WHEN l.title_id IS NOT NULL THEN 'conflicting_after_baseline' ELSE 'additive_nonconflicting' END AS classification, fields, winner
  FROM tops t JOIN tips USING (title_id) LEFT JOIN early USING (title_id) LEFT JOIN late l ON l.title_id = t.title_id),
named AS (SELECT title_id, classification, CASE WHEN classification IN ('resolved_by_source_order', 'conflicting_at_baseline') THEN fields ELSE '' END AS conflict_fields, CASE WHEN classification = 'resolved_by_source_order' THEN winner END AS winner FROM classes)"""


@own("D3_A17_classify_blocks", f"WITH {_TITLE_CLASSES} SELECT * FROM named")
def title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, blocks = title_history(spark, sf_dir)
    return classify.title_classes(blocks, ops, BASELINE).withColumn("conflict_fields", F.array_join("conflict_fields", ","))


@own("D3_block_resolution", f"WITH {_TITLE_CLASSES} SELECT title_id, block_order, classification, CASE WHEN classification = 'unique' THEN 'sole_declaration' WHEN n.winner = block_order THEN 'winner' WHEN n.winner IS NOT NULL THEN 'superseded' ELSE 'unresolved' END AS resolution FROM blocks JOIN named n USING (title_id)")
def block_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, blocks = title_history(spark, sf_dir)
    return classify.title_blocks(blocks, classify.title_classes(blocks, ops, BASELINE)).select("title_id", "block_order", "classification", "resolution")


@own("D5_winner_filter", f"WITH {_TITLE_CLASSES} SELECT o.title_id, block_order, declaration_order FROM ops o JOIN named n USING (title_id) WHERE n.winner IS NULL OR n.winner = block_order")
def winner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, blocks = title_history(spark, sf_dir)
    return classify.effective_operations(ops, classify.title_classes(blocks, ops, BASELINE)).select("title_id", "block_order", "declaration_order")


#: Titles with their static capitals, and capital events.
_STATIC = "SELECT DISTINCT title_id, CASE WHEN length(title_id) % 2 = 0 THEN concat('c_', title_id) END AS capital_id, CASE WHEN length(title_id) % 2 = 0 THEN 'declared_static' ELSE 'no_declaration' END AS capital_status"
_CAPITALS = f"""SELECT concat('k_', user_id % 120) AS title_id, concat('c_', event_id) AS capital_id, CASE WHEN event_id % 2 = 0 THEN 'set_capital_county' ELSE 'set_capital_barony' END AS event_type, {day("ts")} AS effective_date, event_id AS declaration_order, 0 AS step,
CASE event_id % 3 WHEN 0 THEN {BASELINE} WHEN 1 THEN 20240101 END AS required_date, event_id % 5 <> 0 AS valid FROM events WHERE event_type = 'error'"""


@own("D6_title_states", f"""WITH {_TITLE_CLASSES}, titles AS ({_STATIC} FROM ops), kept AS (SELECT o.* FROM ops o JOIN named n USING (title_id) WHERE n.winner IS NULL OR n.winner = block_order),
now AS (SELECT *, operation_key LIKE 'holder%' AND scalar_value IS NOT NULL AS is_holder, try_cast(CASE WHEN operation_key = 'change_development_level' THEN scalar_value END AS BIGINT) AS grows FROM kept WHERE effective_date <= {BASELINE}),
x AS (SELECT title_id, arg_max(scalar_value, (effective_date, declaration_order)) FILTER (WHERE is_holder) AS h, arg_max(operation_key, (effective_date, declaration_order)) FILTER (WHERE is_holder) AS hk,
 arg_max(scalar_value, (effective_date, declaration_order)) FILTER (WHERE operation_key = 'liege') AS l, arg_max(scalar_value, (effective_date, declaration_order)) FILTER (WHERE operation_key = 'government') AS g, CAST(sum(grows) AS BIGINT) AS development,
 string_agg(DISTINCT operation_key, ', ' ORDER BY operation_key) FILTER (WHERE CASE WHEN operation_key = 'change_development_level' THEN grows IS NULL WHEN operation_key LIKE 'holder%' OR operation_key IN ('liege', 'government') THEN scalar_value IS NULL AND NOT evaluated ELSE NOT evaluated END) AS unknown FROM now GROUP BY title_id),
caps AS (SELECT title_id, arg_max(capital_id, (effective_date, declaration_order)) AS capital, arg_max(event_type, (effective_date, declaration_order)) AS kind FROM ({_CAPITALS}) WHERE valid AND effective_date <= {BASELINE} AND coalesce(required_date, {BASELINE}) = {BASELINE} GROUP BY title_id),
y AS (SELECT t.title_id, x.*, capital, kind, capital_id, capital_status AS static_status, classification = 'conflicting_at_baseline' AS clash, conflict_fields AS fields FROM titles t LEFT JOIN x USING (title_id) LEFT JOIN caps USING (title_id) JOIN named USING (title_id)),
z AS (SELECT *, clash AND fields LIKE '%holder%' AS ah, clash AND fields LIKE '%liege%' AS al, clash AND fields LIKE '%government%' AS ag FROM y),
w AS (SELECT title_id, CASE WHEN NOT ah THEN nullif(h, '0') END AS holder, CASE WHEN ah THEN 'ambiguous_duplicate' WHEN h IS NULL THEN 'no_declaration' WHEN h = '0' THEN 'explicit_unheld' WHEN hk = 'holder' THEN 'declared' ELSE 'declared_ignore_head_of_faith_requirement' END AS holder_status,
 CASE WHEN NOT al THEN nullif(l, '0') END AS liege, CASE WHEN al THEN 'ambiguous_duplicate' WHEN l IS NULL THEN 'no_declaration' WHEN l = '0' THEN 'explicit_independent' ELSE 'declared' END AS liege_status,
 CASE WHEN NOT ag THEN g END AS government, CASE WHEN ag THEN 'ambiguous_duplicate' WHEN g IS NULL THEN 'no_declaration' ELSE 'declared' END AS government_status, development, CASE WHEN development IS NULL THEN 'no_declaration' ELSE 'derived' END AS development_status,
 coalesce(capital, capital_id) AS capital, coalesce('history_' || kind, static_status) AS capital_status,
 nullif(concat_ws('; ', CASE WHEN unknown IS NOT NULL THEN concat('not evaluated: ', unknown) END, CASE WHEN clash THEN concat('baseline-conflicting duplicate title declarations: ', replace(fields, ',', ', ')) END), '') AS validation_note FROM z)
SELECT *, CASE WHEN validation_note IS NULL THEN 'valid' ELSE 'warning' END AS validation_status FROM w""")
def title_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, blocks = title_history(spark, sf_dir)
    classes = classify.title_classes(blocks, ops, BASELINE)
    ops.createOrReplaceTempView("title_ops")
    return states.title_states(spark.sql(f"{_STATIC} FROM title_ops"), classify.effective_operations(ops, classes), run_sql(spark, sf_dir, _CAPITALS), classes, BASELINE)


shared("W6_holder_and_laws_at_instant", f"SELECT title_id, declaration_order, last_value(CASE WHEN operation_key = 'holder' THEN scalar_value END) IGNORE NULLS OVER (PARTITION BY title_id ORDER BY effective_date, declaration_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS plain_holder FROM ({TITLE_OPS}) o", f"SELECT title_id, declaration_order, last_value(CASE WHEN operation_key = 'holder' THEN scalar_value END IGNORE NULLS) OVER (PARTITION BY title_id ORDER BY effective_date, declaration_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS plain_holder FROM ({TITLE_OPS}) o")

# --- adapters: character histories from orders

PEOPLE = 19950101
CHARACTER_OPS = f"""SELECT concat('h', o_custkey % 400) AS character_id, CAST(o_custkey AS INT) AS block_order, concat('history/characters/', o_custkey % 3, '.txt') AS source_path, CASE WHEN o_orderkey % 5 <> 0 THEN {day("o_orderdate")} END AS effective_date, o_orderkey AS declaration_order,
CASE o_orderkey % 12 WHEN 0 THEN 'name' WHEN 1 THEN 'female' WHEN 2 THEN 'culture' WHEN 3 THEN 'religion' WHEN 4 THEN 'faith' WHEN 5 THEN 'dynasty' WHEN 6 THEN 'dynasty_house' WHEN 7 THEN 'birth' WHEN 8 THEN 'death' WHEN 9 THEN 'effect' WHEN 10 THEN 'father' ELSE 'trait' END AS operation_key,
CASE o_orderkey % 12 WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END WHEN 7 THEN CASE WHEN o_custkey % 3 = 0 THEN 'yes' ELSE concat(year(o_orderdate) - o_custkey % 2, '.', month(o_orderdate), '.', day(o_orderdate)) END WHEN 9 THEN NULL ELSE concat('v', o_custkey % 40) END AS scalar_value,
CASE WHEN o_orderkey % 12 = 9 AND o_custkey % 4 = 0 THEN concat('set', o_custkey % 6) END AS set_culture, o_custkey % 5 <> 0 AS evaluated FROM orders"""
_LAST = "arg_max({0}, (coalesce(effective_date, 0), declaration_order)) FILTER (WHERE {1} AND coalesce(effective_date, 0) <= " + str(PEOPLE) + ")"


def _pick(keys: str) -> str:
    return _LAST.format("scalar_value", f"operation_key IN ({keys}) AND scalar_value IS NOT NULL")


_LIFE = "arg_max(effective_date, (effective_date, declaration_order)) FILTER (WHERE operation_key = '{0}' AND effective_date IS NOT NULL)"
_CHARACTER_CLASSES = f"""ops AS ({CHARACTER_OPS}),
said AS (SELECT character_id, block_order, sha256(string_agg({_SAID.replace("effective_date", "coalesce(effective_date, 0)")}, chr(10) ORDER BY {_SAID.replace("effective_date", "coalesce(effective_date, 0)")})) AS h,
 {_pick("'name'")} AS display_name, CASE WHEN {_pick("'female'")} = 'yes' THEN 'female' ELSE 'male' END AS sex, {_pick("'culture'")} AS culture_id, {_pick("'religion', 'faith'")} AS faith_id, {_pick("'dynasty'")} AS dynasty_id, {_pick("'dynasty_house'")} AS dynasty_house_id,
 {_LIFE.format("birth")} AS birth_date, {_LIFE.format("death")} AS death_date FROM ops GROUP BY ALL),
classes AS (SELECT character_id, count(DISTINCT h) AS hashes, concat_ws(',', {", ".join(f"CASE WHEN count(DISTINCT {f}) > 1 THEN '{f}' END" for f in sorted(classify.COMPARED))}) AS fields FROM said GROUP BY character_id HAVING count(*) > 1),
named AS (SELECT character_id, CASE WHEN hashes = 1 THEN 'semantic_identical' WHEN fields <> '' THEN 'conflicting_at_baseline' ELSE 'additive_nonconflicting' END AS classification, CASE WHEN hashes = 1 THEN '' ELSE fields END AS conflict_fields FROM classes)"""


def character_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ops = run_sql(spark, sf_dir, CHARACTER_OPS)
    said = F.concat_ws("|", F.coalesce("effective_date", F.lit(0)), "operation_key", F.coalesce("scalar_value", F.lit("")))
    blocks = ops.groupBy("character_id", "block_order", "source_path").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(said))), 256).alias("semantic_sha256"))
    return ops, blocks


@own("D4_character_classes", f"WITH {_CHARACTER_CLASSES} SELECT * FROM named")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, blocks = character_history(spark, sf_dir)
    return classify.character_classes(blocks, ops, PEOPLE).select("character_id", "classification", F.array_join("conflict_fields", ",").alias("conflict_fields"))


_TEXT_DATE = "CASE WHEN {0} IS NOT NULL THEN concat(lpad(CAST({0} // 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST({0} // 100 % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST({0} % 100 AS VARCHAR), 2, '0')) END"


@own("D21_character_states", f"""WITH {_CHARACTER_CLASSES}, found AS (SELECT character_id, {_pick("'name'")} AS name, {_pick("'female'")} AS female,
 {_LAST.format("CASE WHEN operation_key = 'culture' THEN scalar_value ELSE set_culture END", "((operation_key = 'culture' AND scalar_value IS NOT NULL) OR (operation_key = 'effect' AND effective_date IS NOT NULL AND set_culture IS NOT NULL))")} AS culture,
 {_pick("'religion', 'faith'")} AS faith, {_LAST.format("operation_key", "operation_key IN ('religion', 'faith') AND scalar_value IS NOT NULL")} AS faith_key, {_pick("'dynasty'")} AS dynasty, {_pick("'dynasty_house'")} AS house, {_LIFE.format("birth")} AS birth, {_LIFE.format("death")} AS death,
 coalesce(bool_or(operation_key = 'effect' AND effective_date <= {PEOPLE} AND NOT evaluated), false) AS opaque FROM ops GROUP BY character_id),
r AS (SELECT f.*, coalesce(conflict_fields, '') AS fields, coalesce(classification = 'conflicting_at_baseline', false) AS clash FROM found f LEFT JOIN named USING (character_id)),
w AS (SELECT character_id, CASE WHEN fields NOT LIKE '%display_name%' THEN name END AS display_name, CASE WHEN fields LIKE '%sex%' THEN 'unknown' WHEN female = 'yes' THEN 'female' ELSE 'male' END AS sex, CASE WHEN fields LIKE '%sex%' THEN 'ambiguous_duplicate' WHEN female IS NULL THEN 'inferred_default' ELSE 'declared' END AS sex_status,
 CASE WHEN fields NOT LIKE '%culture_id%' THEN culture END AS culture_id, CASE WHEN fields NOT LIKE '%faith_id%' THEN faith END AS faith_id, CASE WHEN fields NOT LIKE '%faith_id%' THEN faith_key END AS faith_source_key, CASE WHEN fields NOT LIKE '%dynasty_id%' THEN dynasty END AS dynasty_id, CASE WHEN fields NOT LIKE '%dynasty_house_id%' THEN house END AS dynasty_house_id,
 CASE WHEN fields NOT LIKE '%birth_date%' THEN {_TEXT_DATE.format("birth")} END AS birth_date, CASE WHEN fields NOT LIKE '%death_date%' THEN {_TEXT_DATE.format("death")} END AS death_date,
 CASE WHEN birth IS NULL THEN 'unknown_birth' WHEN birth > {PEOPLE} THEN 'not_born_at_baseline' WHEN death <= {PEOPLE} THEN 'dead_at_baseline' ELSE 'alive_at_baseline' END AS lifecycle_status,
 nullif(concat_ws('; ', CASE WHEN clash THEN concat('baseline-conflicting duplicate character declarations: ', replace(fields, ',', ', ')) END, CASE WHEN opaque THEN 'not evaluated: effect' END), '') AS validation_note FROM r)
SELECT *, CASE WHEN validation_note IS NULL THEN 'valid' ELSE 'warning' END AS validation_status FROM w""")
def character_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, blocks = character_history(spark, sf_dir)
    classes = classify.character_classes(blocks, ops, PEOPLE)
    return states.character_states(classify.settled_operations(ops, classes), classes, PEOPLE)


@own("D22_lifecycle_events", f"""SELECT character_id, {_TEXT_DATE.format("effective_date")} AS effective_date, operation_key AS event_type, scalar_value AS text_value, declaration_order, CASE WHEN scalar_value LIKE '%.%' AND o_custkey % 2 = 1 THEN 'warning' ELSE 'valid' END AS validation_status,
CASE WHEN scalar_value LIKE '%.%' AND o_custkey % 2 = 1 THEN 'embedded lifecycle date differs from enclosing date' END AS validation_note FROM ({CHARACTER_OPS}) o JOIN orders ON o_orderkey = declaration_order WHERE operation_key IN ('birth', 'death') AND effective_date IS NOT NULL""")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.lifecycle_events(run_sql(spark, sf_dir, CHARACTER_OPS))


_CULTURED = "SELECT concat('h', c_custkey) AS character_id, CASE WHEN c_custkey % 9 <> 0 THEN concat('cu', c_nationkey) END AS culture_id FROM customer"
_LANGUAGES = "SELECT concat('cu', n_nationkey) AS culture_id, concat('language_', n_regionkey) AS language_id FROM nation"


@own("D24_native_languages", f"SELECT character_id, language_id FROM ({_CULTURED}) c JOIN ({_LANGUAGES}) l USING (culture_id)")
def native_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.native_languages(run_sql(spark, sf_dir, _CULTURED), run_sql(spark, sf_dir, _LANGUAGES))[0]


@own("D24_unmapped_cultures", f"SELECT DISTINCT culture_id FROM ({_CULTURED}) c WHERE culture_id IS NOT NULL AND culture_id NOT IN (SELECT concat('cu', r_regionkey) FROM region)")
def unmapped_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = run_sql(spark, sf_dir, "SELECT concat('cu', r_regionkey) AS culture_id, concat('language_', r_regionkey) AS language_id FROM region")
    return states.native_languages(run_sql(spark, sf_dir, _CULTURED), mapping)[1].select(F.col("subject").alias("culture_id"))


_GRANTS = f"SELECT concat('h', o_custkey) AS character_id, concat('cu', o_orderkey % 25) AS culture_id, {day('o_orderdate')} AS effective_date, o_orderkey AS declaration_order, 0 AS step FROM orders"
_KNOWN = "SELECT concat('h', c_custkey) AS character_id, concat('language_', c_nationkey % 5) AS language_id FROM customer"


@own("D25_history_languages", f"SELECT character_id, language_id, effective_date, declaration_order FROM (SELECT *, row_number() OVER (PARTITION BY character_id, language_id ORDER BY effective_date, declaration_order) AS r FROM ({_GRANTS}) g JOIN ({_LANGUAGES}) l USING (culture_id) WHERE effective_date <= {PEOPLE} AND (character_id, language_id) NOT IN (SELECT character_id, language_id FROM ({_KNOWN}))) WHERE r = 1")
def history_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.history_languages(run_sql(spark, sf_dir, _GRANTS), run_sql(spark, sf_dir, _LANGUAGES), run_sql(spark, sf_dir, _KNOWN), PEOPLE)[0]


_NICKNAMES = f"SELECT concat('h', o_custkey) AS character_id, CASE WHEN o_orderkey % 4 <> 0 THEN concat('nick_', o_orderkey % 130) END AS nickname_id, {day('o_orderdate')} AS effective_date, o_orderkey AS declaration_order, 0 AS step FROM orders"


@own("D26_nickname_states", f"SELECT character_id, nickname_id, CASE WHEN nickname_id IS NULL THEN 'clear' ELSE 'set' END AS event_kind, effective_date, declaration_order FROM (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY effective_date DESC, declaration_order DESC) AS r FROM ({_NICKNAMES}) n WHERE effective_date <= {PEOPLE}) WHERE r = 1")
def nicknames(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("nick_"), "s_suppkey").alias("nickname_id"))
    return states.nickname_states(run_sql(spark, sf_dir, _NICKNAMES), catalog, PEOPLE)[0]


@own("D26_unresolved_nicknames", f"SELECT DISTINCT nickname_id AS subject FROM ({_NICKNAMES}) n WHERE nickname_id IS NOT NULL AND nickname_id NOT IN (SELECT concat('nick_', s_suppkey) FROM supplier)")
def unresolved_nicknames(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("nick_"), "s_suppkey").alias("nickname_id"))
    return states.nickname_states(run_sql(spark, sf_dir, _NICKNAMES), catalog, PEOPLE)[1].select("subject")


_CONTRACTS = f"SELECT concat('h', o_custkey) AS subject_id, o_orderpriority AS contract_type_id, {day('o_orderdate')} AS effective_date, o_orderkey AS declaration_order, CAST(o_orderkey % 4 AS INT) AS level_index, concat('level_', o_orderkey % 4) AS obligation_id, concat('l', o_custkey % 10) AS liege_id FROM orders"


@own("D27_contract_states", f"SELECT subject_id, contract_type_id, obligation_id, level_index, liege_id, effective_date, declaration_order FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, contract_type_id ORDER BY effective_date DESC, declaration_order DESC) AS r FROM ({_CONTRACTS}) c WHERE effective_date <= {PEOPLE}) WHERE r = 1")
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.contract_states(run_sql(spark, sf_dir, _CONTRACTS), PEOPLE)


_WRITES = "SELECT concat('h', c_custkey) AS subject_id, 8670101 AS effective_date, 'a.txt' AS source_path, CASE WHEN c_custkey % 11 <> 0 THEN concat('type_', c_nationkey) END AS contract_type_id, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 3 AS INT) END AS level_index FROM customer"
_REVIEWED = "SELECT concat('h', c_custkey + CASE WHEN c_custkey % 50 = 0 THEN 1000000 ELSE 0 END) AS subject_id, 8670101 AS effective_date, 'a.txt' AS source_path, CASE WHEN c_custkey % 11 <> 0 THEN concat('type_', c_nationkey) END AS contract_type_id, CASE WHEN c_custkey % 11 <> 0 THEN CAST(CASE WHEN c_custkey % 40 = 0 THEN 9 ELSE c_custkey % 3 END AS INT) END AS level_index, 'l1' AS liege_id FROM customer"
_OBLIGATIONS = "SELECT DISTINCT concat('type_', n_nationkey) AS contract_type_id, CAST(r_regionkey AS INT) AS level_index FROM nation, region WHERE r_regionkey < 3 AND n_nationkey <> 7"
_LIEGES = "SELECT concat('h', c_custkey) AS subject_id, CASE WHEN c_custkey % 60 = 0 THEN 'l2' ELSE 'l1' END AS liege_id FROM customer"


@own("D27_contract_problems", f"""WITH w AS ({_WRITES}), r AS ({_REVIEWED}), k AS (SELECT r.* FROM r JOIN w USING (subject_id, effective_date, source_path) WHERE r.contract_type_id IS NOT NULL)
SELECT 'reviewed contract set changed' AS rule, concat(coalesce(r.subject_id, w.subject_id), '|8670101|a.txt') AS subject FROM r FULL JOIN w ON r.subject_id = w.subject_id WHERE r.subject_id IS NULL OR w.subject_id IS NULL
UNION ALL SELECT 'reviewed contract body changed', concat(r.subject_id, '|8670101|a.txt') FROM r JOIN w ON r.subject_id = w.subject_id WHERE (r.contract_type_id, r.level_index) IS DISTINCT FROM (w.contract_type_id, w.level_index)
UNION ALL SELECT 'obligation isn''t installed', concat(subject_id, '|8670101|a.txt') FROM k WHERE (contract_type_id, level_index) NOT IN ({_OBLIGATIONS})
UNION ALL SELECT 'liege changed', concat(subject_id, '|8670101|a.txt') FROM k WHERE subject_id NOT IN (SELECT subject_id FROM ({_LIEGES}) x WHERE liege_id = 'l1')""")
def contract_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("h"), "c_custkey").alias("character_id"))
    w, r, k, x = (run_sql(spark, sf_dir, q) for q in (_WRITES, _REVIEWED, _OBLIGATIONS, _LIEGES))
    return states.contract_problems(w, r, k, people, x)


_HOLDERS = "SELECT concat('t', o_orderkey) AS title_id, concat('h', o_custkey) AS holder_id FROM orders"
_LIVES = "SELECT concat('h', c_custkey) AS character_id, CASE c_custkey % 4 WHEN 0 THEN 'dead_at_baseline' ELSE 'alive_at_baseline' END AS lifecycle_status FROM customer WHERE c_acctbal > 0"
_TWICE = "SELECT concat('h', l_suppkey) AS character_id FROM lineitem WHERE l_quantity > 49"
_RULED = "SELECT concat('t', c_custkey) AS title_id, coalesce((SELECT max(concat('h', o_custkey)) FROM orders WHERE o_orderkey = c_custkey AND o_orderstatus = 'F'), 'h0') AS declared_id, concat('h', c_custkey + 1) AS resolved_id, c_name AS review_note FROM customer"


@own("D28_holder_validation", f"""WITH r AS (SELECT h.*, a.declared_id, a.review_note, coalesce(a.declared_id = h.holder_id, false) AS now, CASE WHEN a.declared_id = h.holder_id THEN a.resolved_id ELSE h.holder_id END AS who FROM ({_HOLDERS}) h LEFT JOIN ({_RULED}) a USING (title_id)),
s AS (SELECT r.*, coalesce(lifecycle_status, 'unknown') AS life, who IN (SELECT character_id FROM ({_TWICE})) AS twice, CASE WHEN now THEN 'runtime_adjudicated' WHEN lifecycle_status IS NULL THEN 'missing' ELSE 'found' END AS declared FROM r LEFT JOIN ({_LIVES}) l ON l.character_id = who)
SELECT title_id, who AS holder_character_id, declared AS declaration_status, CASE WHEN twice THEN 'duplicate' ELSE 'unique' END AS uniqueness_status, life AS lifecycle_status, CASE WHEN declared <> 'missing' AND NOT twice AND life = 'alive_at_baseline' THEN 'valid' ELSE 'warning' END AS validation_status,
nullif(concat_ws('; ', CASE WHEN now THEN concat(review_note, '; installed declaration retained as ', holder_id) WHEN declared_id IS NOT NULL THEN 'runtime adjudication does not match the current installed declaration' END, CASE WHEN declared = 'missing' THEN 'holder has no character declaration' END,
 CASE WHEN twice THEN 'holder character has duplicate declarations' END, CASE WHEN life <> 'alive_at_baseline' THEN concat('holder lifecycle is ', life) END), '') AS validation_note FROM s""")
def holder_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.holder_validations(*(run_sql(spark, sf_dir, q) for q in (_HOLDERS, _LIVES, _TWICE, _RULED)))


_REQUESTS = "SELECT concat('t', c_custkey) AS title_id, concat('h', c_custkey % 50) AS resolved_id, concat('t', c_custkey % 70) AS primary_title_id, array({0}) AS domain, 8670101 + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS save_date, CASE WHEN c_custkey % 8 = 0 THEN '1.18' ELSE '1.19' END AS save_version, 8670101 AS baseline_date, '1.19' AS baseline_version, c_custkey % 30 = 0 AS promoted FROM customer"
_DOMAIN = "concat('t', c_custkey - c_custkey % 3)"


@own("D29_save_adjudications", f"""WITH q AS ({_REQUESTS.format(_DOMAIN).replace("array(", "list_value(")}), h AS ({_HOLDERS})
SELECT q.title_id, h.holder_id AS declared_id, resolved_id, concat_ws('; ', CASE WHEN promoted THEN 'Promoted reference evidence cannot be adjudicated' END, CASE WHEN save_date <> baseline_date THEN 'Save date does not match baseline date' END, CASE WHEN save_version <> baseline_version THEN 'Save version does not match' END,
 CASE WHEN q.title_id <> domain[1] THEN 'Observed title is not in the player''s saved domain' END, CASE WHEN h.holder_id IS NULL THEN 'Title lacks an installed holder declaration' END, CASE WHEN p.holder_id IS DISTINCT FROM resolved_id THEN 'Resolved character does not match the installed holder of the saved primary title' END,
 CASE WHEN lifecycle_status IS DISTINCT FROM 'alive_at_baseline' OR resolved_id IN (SELECT character_id FROM ({_TWICE})) THEN 'Resolved character is not unique and alive at the baseline' END) AS reasons
FROM q LEFT JOIN h USING (title_id) LEFT JOIN h p ON p.title_id = primary_title_id LEFT JOIN ({_LIVES}) l ON l.character_id = resolved_id""")
def save_adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.save_adjudications(*(run_sql(spark, sf_dir, q) for q in (_REQUESTS.format(_DOMAIN), _HOLDERS, _LIVES, _TWICE)))


# --- hierarchy, names and baselines

_ONE = f"SELECT title_id, min(parent_title_id) AS parent_title_id, min(source_order) AS source_order FROM ({TITLES}) GROUP BY title_id"


#: Titles whose parents don't rise: lines in a row within an order and orders in a row of twenty, which end well, run in circles, or lead nowhere.
_ODD_TITLES = """SELECT concat('b_', l_orderkey, '_', l_linenumber) AS title_id,
  CASE WHEN l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN concat('b_', l_orderkey, '_', l_linenumber + 1)
    WHEN l_orderkey % 5 = 0 THEN concat('b_', l_orderkey, '_', min(l_linenumber) OVER (PARTITION BY l_orderkey))
    WHEN l_orderkey % 5 = 1 THEN concat('c_x', l_orderkey) WHEN l_orderkey % 5 > 2 THEN concat('c_', l_orderkey) END AS parent_title_id,
  l_orderkey * 10 + l_linenumber AS source_order FROM lineitem
UNION ALL SELECT concat('c_', o_orderkey), CASE WHEN o_orderkey % 20 = 0 THEN concat('d_', o_custkey) WHEN o_orderkey % 200 = 7 THEN concat('c_', o_orderkey - 6) ELSE concat('c_', o_orderkey + 1) END, o_orderkey FROM orders
UNION ALL SELECT concat('d_', c_custkey), concat('k_', c_nationkey), c_custkey FROM customer
UNION ALL SELECT concat('k_', n_nationkey), CASE WHEN n_nationkey % 9 < 8 THEN concat('e_', n_regionkey) END, CAST(n_nationkey AS bigint) FROM nation
UNION ALL SELECT concat('e_', r_regionkey), NULL, CAST(r_regionkey AS bigint) FROM region"""


@own("D1_faulty_chains", f"""WITH RECURSIVE t AS ({_ODD_TITLES}), one AS MATERIALIZED (SELECT title_id, arg_min_null(parent_title_id, source_order) AS parent, count(*) AS n FROM t GROUP BY title_id),
up AS (SELECT title_id, parent AS next, title_id[1] AS ranks, [title_id] AS seen, false AS cyclic, 0 AS hops FROM one
  UNION ALL SELECT up.title_id, o.parent, ranks || o.title_id[1], list_append(seen, o.title_id), o.parent IS NOT NULL AND list_contains(list_append(seen, o.title_id), o.parent), hops + 1
  FROM up JOIN one o ON o.title_id = up.next WHERE NOT cyclic),
ends AS (SELECT title_id, arg_max(ranks, hops) AS ranks, arg_max_null(next, hops) AS missing, arg_max(cyclic, hops) OR (max(hops) = 0 AND arg_max_null(next, hops) IS NOT DISTINCT FROM title_id) AS cyclic FROM up GROUP BY title_id),
w AS (SELECT title_id, CASE WHEN n > 1 THEN 'duplicate title declarations' WHEN cyclic THEN 'cyclic parent hierarchy' WHEN missing IS NOT NULL THEN concat('missing parent title: ', missing)
  WHEN ranks <> substring('bcdke', instr('bcdke', title_id[1])) THEN concat('non-canonical rank chain: ', ranks) END AS warning FROM ends JOIN one USING (title_id))
SELECT title_id, warning IS NULL AS selectable, warning FROM w""")
def faulty_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.validated(run_sql(spark, sf_dir, _ODD_TITLES))


@own("J9_chain", f"""WITH RECURSIVE t AS ({_ONE}), up AS (SELECT title_id AS leaf, title_id, parent_title_id, 0 AS depth FROM t WHERE title_id LIKE 'b%' UNION ALL SELECT up.leaf, t.title_id, t.parent_title_id, up.depth + 1 FROM up JOIN t ON t.title_id = up.parent_title_id) SELECT leaf, title_id, depth FROM up""")
def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchy.declared(titles(spark, sf_dir))
    return hierarchy.ancestors(nodes.where("title_id like 'b%'"), nodes)


_SELECTABLE = "SELECT title_id, {0} AS title_rank, parent_title_id, title_id NOT LIKE 'c_%7' AS selectable FROM ({1}) x"
_RANKED = "CASE substring(title_id, 1, 1) WHEN 'e' THEN 'empire' WHEN 'k' THEN 'kingdom' WHEN 'd' THEN 'duchy' WHEN 'c' THEN 'county' ELSE 'barony' END"


@own("J10_resolve_chain", f"""WITH t AS ({_SELECTABLE.format(_RANKED, _ONE)}), s AS (SELECT * FROM t WHERE selectable),
j AS (SELECT t.title_id, t.selectable, t.title_rank, t.parent_title_id AS p1, a.title_id AS a1, b.title_id AS a2, c.title_id AS a3, a.parent_title_id AS p2, b.parent_title_id AS p3, c.parent_title_id AS p4, d.title_id AS a4 FROM t LEFT JOIN s a ON a.title_id = t.parent_title_id LEFT JOIN s b ON b.title_id = a.parent_title_id LEFT JOIN s c ON c.title_id = b.parent_title_id LEFT JOIN s d ON d.title_id = c.parent_title_id WHERE t.title_id LIKE 'b%'),
e AS (SELECT *, CASE WHEN NOT selectable THEN concat('Unknown or non-selectable title: ', title_id) WHEN p1 IS NULL THEN concat('Incomplete title hierarchy above: ', title_id) WHEN a1 IS NULL OR a1[1] <> 'c' THEN concat('Invalid parent for title: ', title_id) WHEN p2 IS NULL THEN concat('Incomplete title hierarchy above: ', a1) WHEN a2 IS NULL OR a2[1] <> 'd' THEN concat('Invalid parent for title: ', a1)
 WHEN p3 IS NULL THEN concat('Incomplete title hierarchy above: ', a2) WHEN a3 IS NULL OR a3[1] <> 'k' THEN concat('Invalid parent for title: ', a2) WHEN p4 IS NULL THEN concat('Incomplete title hierarchy above: ', a3) WHEN a4 IS NULL OR a4[1] <> 'e' THEN concat('Invalid parent for title: ', a3) END AS error FROM j)
SELECT title_id, error, CASE WHEN error IS NULL THEN a4 END AS empire, CASE WHEN error IS NULL THEN a3 END AS kingdom, CASE WHEN error IS NULL THEN a2 END AS duchy, CASE WHEN error IS NULL THEN a1 END AS county, CASE WHEN error IS NULL THEN title_id END AS barony FROM e""")
def resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = run_sql(spark, sf_dir, _SELECTABLE.format(_RANKED, _ONE))
    return hierarchy.resolved(known.where("title_id like 'b%'"), known)


@own("D2_capital_statuses", f"""WITH t AS (SELECT *, CASE WHEN title_id LIKE 'c%3' THEN concat('b_', substring(title_id, 3)) END AS said FROM ({_ONE}) x), f AS (SELECT parent_title_id AS title_id, arg_min(title_id, source_order) AS first FROM t WHERE title_id LIKE 'b%' GROUP BY ALL)
SELECT t.title_id, coalesce(said, CASE WHEN t.title_id LIKE 'c%' THEN first END) AS capital_id, CASE WHEN said IS NOT NULL THEN 'declared_static' WHEN t.title_id LIKE 'c%' AND first IS NOT NULL THEN 'derived_first_barony' WHEN t.title_id LIKE 'b%' THEN 'not_applicable' ELSE 'no_declaration' END AS capital_status FROM t LEFT JOIN f USING (title_id)""")
def capital_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("title_id").like("c%3"), F.concat(F.lit("b_"), F.substring("title_id", 3, 99)))
    return hierarchy.static_capitals(run_sql(spark, sf_dir, _ONE).withColumn("capital_title_id", said))


#: Labels of lines: each leads to the one before, through twelve orders; the first has a text, leads to itself or to none.
_LABELS = """SELECT concat('l', l_orderkey, '_', l_linenumber) AS localization_key,
  CASE WHEN before IS NOT NULL AND l_orderkey % 12 > 0 THEN concat('$', before, '$') WHEN l_orderkey % 36 = 12 THEN concat('$l', l_orderkey, '_', l_linenumber, '$')
    WHEN l_orderkey % 36 = 24 THEN '$none$' ELSE concat('text ', l_orderkey, ' $', l_linenumber, '$') END AS display_value
FROM (SELECT *, lag(concat('l', l_orderkey, '_', l_linenumber)) OVER (PARTITION BY l_orderkey - l_orderkey % 12 ORDER BY l_orderkey, l_linenumber) AS before FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d) x"""


@own("J11_followed_labels", f"""WITH RECURSIVE l AS ({_LABELS}), go AS (SELECT localization_key, display_value, 0 AS hops FROM l UNION ALL SELECT go.localization_key, l.display_value, hops + 1 FROM go JOIN l ON go.display_value = concat('$', l.localization_key, '$') AND l.display_value <> go.display_value)
SELECT localization_key, display_value AS display_name FROM go WHERE display_value NOT LIKE '$%'""")
def followed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = run_sql(spark, sf_dir, _LABELS)
    return hierarchy.followed(labels.select("localization_key"), labels)


_SUPPORTED = "SELECT concat('b', n_nationkey) AS baseline_id, concat('s', n_nationkey % 3) AS reference_snapshot_id, concat('1.', n_regionkey) AS game_version, 19920101 + n_nationkey % 6 * 10000 AS baseline_date FROM nation"
_SAVES = f"SELECT o_orderkey AS request_id, concat('1.', o_custkey % 6) AS game_version, {day('o_orderdate')} AS game_date, CASE WHEN o_orderkey % 4 = 0 THEN concat('s', o_orderkey % 3) END AS reference_snapshot_id, CAST(NULL AS varchar(40)) AS baseline_id FROM orders"
_MATCHED = f"""m AS (SELECT request_id, b.baseline_id, b.reference_snapshot_id, baseline_date, rank() OVER (PARTITION BY request_id ORDER BY baseline_date DESC) AS r FROM ({_SAVES}) s JOIN ({_SUPPORTED}) b ON s.game_version = b.game_version AND baseline_date <= game_date AND coalesce(s.reference_snapshot_id, b.reference_snapshot_id) = b.reference_snapshot_id),
n AS (SELECT request_id, count(*) AS n, min(baseline_id) AS baseline_id, min(reference_snapshot_id) AS reference_snapshot_id, min(baseline_date) AS baseline_date FROM m WHERE r = 1 GROUP BY request_id),
found AS (SELECT s.request_id, CASE WHEN n = 1 THEN n.baseline_id END AS baseline_id, CASE WHEN n = 1 THEN n.reference_snapshot_id END AS reference_snapshot_id, CASE WHEN n = 1 THEN n.baseline_date END AS baseline_date, CASE WHEN n IS NULL THEN 'No promoted reference baseline matches the save version and date' WHEN n > 1 THEN 'Multiple promoted baselines match; select a reference snapshot explicitly' END AS error FROM ({_SAVES}) s LEFT JOIN n USING (request_id))"""


@own("J14_asof_baseline", f"WITH {_MATCHED} SELECT * FROM found")
def asof_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.matched(run_sql(spark, sf_dir, _SAVES), run_sql(spark, sf_dir, _SUPPORTED))


_DOMAINS = "SELECT l_orderkey AS request_id, max(concat('b_', l_orderkey, '_', l_linenumber)) AS realm_capital_title_id FROM lineitem GROUP BY l_orderkey"


@own("D38_save_proposals", f"""WITH {_MATCHED}, t AS ({_SELECTABLE.format(_RANKED, _ONE)}), d AS ({_DOMAINS}), j AS (SELECT f.*, d.realm_capital_title_id AS b, t.parent_title_id AS c, c.parent_title_id AS du, k.parent_title_id AS k, e.parent_title_id AS e, c.selectable AS cs, k.title_id AS ku, e.title_id AS eu, concat('d_', o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 10000000 ELSE 0 END) AS main
 FROM found f JOIN d USING (request_id) JOIN orders ON o_orderkey = request_id LEFT JOIN t ON t.title_id = d.realm_capital_title_id LEFT JOIN t c ON c.title_id = t.parent_title_id LEFT JOIN t k ON k.title_id = c.parent_title_id LEFT JOIN t e ON e.title_id = k.parent_title_id),
x AS (SELECT request_id, baseline_id, baseline_date, coalesce(error, CASE WHEN main NOT IN (SELECT title_id FROM t) THEN concat('Save title is absent from the matched reference baseline: ', main) END, CASE WHEN NOT cs THEN concat('Invalid parent for title: ', b) WHEN k[1] <> 'k' OR k NOT IN (SELECT title_id FROM t) THEN concat('Invalid parent for title: ', du) END) AS error, b, c, du, k, e FROM j)
SELECT request_id, baseline_id, baseline_date, CASE WHEN error IS NULL THEN e END AS starting_empire_id, CASE WHEN error IS NULL THEN k END AS starting_kingdom_id, CASE WHEN error IS NULL THEN du END AS starting_duchy_id, CASE WHEN error IS NULL THEN c END AS starting_county_id, CASE WHEN error IS NULL THEN b END AS starting_barony_id, error FROM x""")
def save_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = run_sql(spark, sf_dir, _SELECTABLE.format(_RANKED, _ONE))
    main = run_sql(spark, sf_dir, "SELECT o_orderkey AS request_id, concat('d_', o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 10000000 ELSE 0 END) AS primary_title_id FROM orders")
    saves = run_sql(spark, sf_dir, _SAVES).join(run_sql(spark, sf_dir, _DOMAINS), "request_id").join(main, "request_id").withColumn("domain_title_ids", F.array("realm_capital_title_id"))
    return baselines.proposals(saves, run_sql(spark, sf_dir, _SUPPORTED), known)


@own("P2_selector_options", f"SELECT display_name AS label, title_id AS value, parent_title_id FROM ({TITLES}) t WHERE title_id LIKE 'd%' AND parent_title_id = 'k_3' AND (display_name ILIKE '%00%' OR title_id ILIKE '%00%')")
def selector_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.options(titles(spark, sf_dir).withColumn("title_rank", hierarchy.rank_of(F.col("title_id"))), "duchy", "k_3", " 00 ")


# --- scalar functions, predicates and set tests

@own("F9_fallback_name", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(replace(p_type, ' ', '_')), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS name FROM (SELECT p_partkey, replace(lower(p_type), '_', ' ') AS p_type FROM part) x".replace("lower(replace(p_type, ' ', '_'))", "p_type"))
def fallback_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.fallback_name(F.concat(F.lit("k_"), F.translate("p_type", " ", "_"))).alias("name"))


@own("F18_half_even", "SELECT o_orderkey, (c // 8 + CASE WHEN c % 8 > 4 OR (c % 8 = 4 AND c // 8 % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS rounded FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) x")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", summary.half_even(F.col("o_totalprice").cast("decimal(28,2)") / 8).alias("rounded"))


@own("F19_word_uses", "SELECT 'token' AS id, CAST(doc_id AS VARCHAR) AS path FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])token($|[^A-Za-z0-9_])') UNION ALL SELECT 'the', CAST(doc_id AS VARCHAR) FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')")
def word_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return freeze.word_uses(files, spark.createDataFrame([("token",), ("the",)], "id string"))


@own("F20_composed_paths", "SELECT doc_id, nfc_normalize(text) AS composed FROM documents")
def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.nfc("text").alias("composed"))


@own("F14_scopes", "SELECT c_custkey, c_name AS bare FROM customer")
def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.get(F.array(*map(F.lit, ("title:", "culture:", "faith:", "flag:", ""))), (F.col("c_custkey") % 5).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.unscoped(F.concat(scope, "c_name")).alias("bare"))


@own("A12_development_fold", f"SELECT title_id, CAST(sum(try_cast(scalar_value AS BIGINT)) AS BIGINT) AS development FROM ({TITLE_OPS}) o WHERE operation_key = 'change_development_level' GROUP BY title_id")
def development(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = title_operations(spark, sf_dir).where("operation_key = 'change_development_level'")
    return ops.groupBy("title_id").agg(F.sum(states.whole_number(F.concat(F.lit(" "), "scalar_value"))).alias("development"))


shared("P10_string_dates", f"SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN concat(lpad(concat('', year(o_orderdate)), 4, '0'), '-', lpad(concat('', month(o_orderdate)), 2, '0'), '-', lpad(concat('', day(o_orderdate)), 2, '0')) END AS d FROM orders) x WHERE d <= '{str(PEOPLE)[:4]}-01-01'")


@own("U4_subset_tests", "SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'R')) AS inside FROM lineitem GROUP BY l_orderkey")
def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Three flags at most.
    flags = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.select("l_orderkey", text.subset(F.col("flags"), F.array(F.lit("A"), F.lit("R"))).alias("inside"))


shared("U5_set_equality", "SELECT count(*) = 0 AS equal FROM ((SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) x")
shared("U7_evidence_diff", "SELECT b.user_id, CASE WHEN a.n IS NOT DISTINCT FROM b.n THEN 'current' ELSE 'stale' END AS status FROM (SELECT user_id, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-16 00:00:00' GROUP BY user_id) b LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY user_id) a ON a.user_id = b.user_id")


@own("K8_update_from", "SELECT c_custkey, CASE WHEN o_custkey IS NOT NULL THEN p ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o_custkey = c_custkey")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    source = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return sinks.updated(rows, source, ["c_custkey"], ["c_mktsegment"])


# --- summaries

_HOLDINGS = "SELECT concat('County ', c_nationkey) AS County_Name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS Duchy_Name, CAST(c_acctbal AS DECIMAL(18, 2)) AS Tax, CAST(c_custkey % 300 AS BIGINT) AS Levies, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 100 AS BIGINT) END AS Control, CAST(c_custkey % 17 AS BIGINT) AS Development, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS Terrain_Type FROM customer"


@own("A7_dashboard", f"SELECT count(DISTINCT County_Name) AS counties_total, count(DISTINCT nullif(Duchy_Name, '')) AS duchies_held, count(*) AS domain_size, CAST(sum(Tax) AS DOUBLE) AS total_tax, CAST(sum(Levies) AS BIGINT) AS total_levies, count(*) FILTER (WHERE coalesce(Control, 100) <= 25) AS control_low_count, CAST(round_even(CAST(sum(Development) AS DECIMAL(28, 10)) / count(*), 2) AS DOUBLE) AS development_avg FROM ({_HOLDINGS}) h")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dashboard(run_sql(spark, sf_dir, _HOLDINGS))


@own("A7_empty_dashboard", "SELECT CAST(NULL AS BIGINT) AS counties_total, CAST(NULL AS BIGINT) AS duchies_held, CAST(NULL AS BIGINT) AS domain_size, CAST(NULL AS DOUBLE) AS total_tax, CAST(NULL AS BIGINT) AS total_levies, CAST(NULL AS BIGINT) AS control_low_count, CAST(NULL AS DOUBLE) AS development_avg")
def empty_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dashboard(run_sql(spark, sf_dir, _HOLDINGS).where("County_Name is null"))


@own("A8_distribution", "SELECT coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, 'Unknown') AS terrain, count(*) AS n FROM customer GROUP BY 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.distribution(run_sql(spark, sf_dir, _HOLDINGS), "Terrain_Type").select(F.explode("distribution").alias("terrain", "n"))


#: A run for each region, with counties, slots, holdings and titles.
_RUNS = "SELECT concat('run_', r_regionkey) AS playthrough_id, CASE WHEN r_regionkey = 3 THEN '1.18' ELSE '1.19' END AS game_version FROM region"
_COUNTIES = "SELECT concat('run_', o_orderkey % 5) AS playthrough_id, concat('c_', o_orderkey) AS county_id, concat('d_', o_custkey) AS duchy_id, concat('County ', o_orderkey) AS county_name, CASE WHEN o_orderstatus = 'F' THEN 'domain' ELSE 'realm' END AS ownership_scope, CAST(o_orderkey % 101 AS BIGINT) AS control FROM orders"
_SLOTS = "SELECT concat('b_', l_orderkey, '_', l_linenumber, '_', l_partkey) AS barony_id, concat('c_', l_orderkey) AS county_id, concat('d_', o_custkey) AS duchy_id, l_returnflag = 'N' AS is_open_barony_slot, l_linenumber = 1 AS is_county_capital FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_HELD = "SELECT concat('run_', l_orderkey % 5) AS playthrough_id, concat('b_', l_orderkey, '_', l_linenumber, '_', l_partkey) AS barony_id, concat('c_', l_orderkey) AS county_id, concat('d_', o_custkey) AS duchy_id, CASE WHEN l_returnflag = 'N' THEN 'empty' ELSE 'castle' END AS holding_type, CASE WHEN l_linestatus = 'F' THEN 'ruler' ELSE 'vassal' END AS holder_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_PROGRESS = "SELECT concat('run_', c_custkey % 5) AS playthrough_id, concat('d_', c_custkey) AS title_id, c_name AS title_name, CASE WHEN c_acctbal < 0 THEN 'not_created' ELSE 'held' END AS title_status, CAST(c_custkey % 6 AS BIGINT) AS de_jure_county_count, CAST(c_custkey % 4 AS BIGINT) AS domain_county_count, CAST(c_custkey % 5 AS BIGINT) AS realm_county_count, c_acctbal AS creation_gold_cost FROM customer"
_TITLE_ROWS = f"""SELECT t.*, coalesce(d, 0) AS domain_barony_count, coalesce(r, 0) AS realm_barony_count, coalesce(b, 0) AS base_barony_count, coalesce(o, 0) AS observed_county_count FROM ({_PROGRESS}) t
LEFT JOIN (SELECT playthrough_id, duchy_id, count(*) FILTER (WHERE holder_type = 'ruler') AS d, count(*) AS r FROM ({_HELD}) h WHERE holding_type <> 'empty' GROUP BY ALL) h ON h.playthrough_id = t.playthrough_id AND h.duchy_id = title_id
LEFT JOIN (SELECT playthrough_id, duchy_id, count(*) AS o FROM ({_COUNTIES}) c GROUP BY ALL) c ON c.playthrough_id = t.playthrough_id AND c.duchy_id = title_id LEFT JOIN (SELECT duchy_id, count(*) AS b FROM ({_SLOTS}) s GROUP BY ALL) s ON s.duchy_id = title_id"""
_TOTALS = f"""SELECT playthrough_id, game_version, coalesce(n, 0) AS county_count, coalesce(d, 0) AS domain_county_count, coalesce(n, 0) AS realm_county_count, coalesce(hd, 0) AS domain_barony_count, coalesce(hr, 0) AS realm_barony_count, (SELECT count(*) FROM ({_SLOTS}) s WHERE duchy_id = 'd_7') AS base_barony_count FROM ({_RUNS}) r
LEFT JOIN (SELECT playthrough_id, count(*) AS n, count(*) FILTER (WHERE ownership_scope = 'domain') AS d FROM ({_COUNTIES}) c GROUP BY ALL) c USING (playthrough_id) LEFT JOIN (SELECT playthrough_id, count(*) FILTER (WHERE holder_type = 'ruler') AS hd, count(*) FILTER (WHERE holding_type <> 'empty') AS hr FROM ({_HELD}) h GROUP BY ALL) h USING (playthrough_id)"""


@own("A9_title_summaries", _TITLE_ROWS)
def title_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.title_summaries(*(run_sql(spark, sf_dir, q) for q in (_PROGRESS, _COUNTIES, _HELD, _SLOTS)))


@own("A9_trial_summary", _TOTALS)
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_totals(*(run_sql(spark, sf_dir, q) for q in (_RUNS, _COUNTIES, _HELD, _SLOTS)), duchy_id="d_7")


@own("D43_proof", f"SELECT playthrough_id, game_version = '1.19' AND domain_county_count > 0 AND EXISTS (SELECT 1 FROM ({_TITLE_ROWS}) t WHERE t.playthrough_id = x.playthrough_id AND title_id = 'd_2' AND title_status = 'held' AND domain_county_count = 2) AS holds FROM ({_TOTALS}) x")
def proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = trial_summary(spark, sf_dir).withColumn("some", F.col("domain_county_count") > 0)
    return summary.proven(totals, title_summaries(spark, sf_dir), {"game_version": "1.19", "some": True}, {"d_2": {"title_status": "held", "domain_county_count": 2}})


@own("A10_scope_rollup", f"""SELECT b.duchy_id, coalesce(c_name, b.duchy_id) AS duchy_name, coalesce(names, '') AS county_names, base_counties, coalesce(seen, 0) AS observed_counties, concat(CAST(round_even(100.0 * coalesce(seen, 0) / base_counties, 0) AS BIGINT), '%') AS county_coverage, total - open AS owned, open, total
FROM (SELECT duchy_id, count(DISTINCT county_id) AS base_counties, count(*) AS total, count(*) FILTER (WHERE is_open_barony_slot) AS open FROM ({_SLOTS}) s GROUP BY duchy_id) b LEFT JOIN (SELECT duchy_id, count(DISTINCT county_id) AS seen, string_agg(DISTINCT county_name, ', ' ORDER BY county_name) AS names FROM ({_COUNTIES}) c GROUP BY duchy_id) c USING (duchy_id) LEFT JOIN customer ON concat('d_', c_custkey) = b.duchy_id""")
def scope_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.duchy_scopes(run_sql(spark, sf_dir, _SLOTS), run_sql(spark, sf_dir, _COUNTIES), run_sql(spark, sf_dir, _PROGRESS))


@own("A11_P16_county_rows", f"""SELECT c.county_id, county_name, duchy_id, concat(coalesce(o, 0), '/', coalesce(s, 0)) AS occupied_slots, CASE WHEN control < 50 THEN 'Control watch' ELSE 'Stable' END AS status FROM ({_COUNTIES}) c LEFT JOIN (SELECT county_id, count(*) AS s FROM ({_SLOTS}) x GROUP BY ALL) s USING (county_id) LEFT JOIN (SELECT county_id, count(*) FILTER (WHERE holding_type <> 'empty') AS o FROM ({_HELD}) y GROUP BY ALL) h USING (county_id)""")
def county_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.county_rows(run_sql(spark, sf_dir, _COUNTIES), run_sql(spark, sf_dir, _SLOTS), run_sql(spark, sf_dir, _HELD))


_LIFECYCLE = "SELECT concat('c_', l_orderkey) AS county_id, l_linestatus = 'F' AS active_in_editor FROM lineitem"


@own("D42_active_counties", f"SELECT county_id FROM ({_COUNTIES}) c WHERE county_id NOT IN (SELECT county_id FROM ({_LIFECYCLE}) l WHERE NOT active_in_editor)")
def active_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.active(run_sql(spark, sf_dir, _COUNTIES), run_sql(spark, sf_dir, _LIFECYCLE)).select("county_id")


_COUNTY_BASE = "SELECT concat('c_', c_custkey) AS county_id, CAST(50 AS BIGINT) AS control, CAST(c_custkey % 20 AS BIGINT) AS development, CAST(NULL AS BIGINT) AS popular_opinion, 'base' AS observed_at FROM customer"
_COUNTY_SEEN = "SELECT concat('c_', o_custkey + CASE WHEN o_orderkey % 100 = 0 THEN 10000000 ELSE 0 END) AS county_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 END AS control, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 30 END AS development, o_orderkey % 7 AS popular_opinion, concat('', o_orderdate) AS observed_at, o_orderkey AS transaction_id FROM orders"


@own("D41_county_overlay", f"SELECT county_id, coalesce(s.control, b.control) AS control, coalesce(s.development, b.development) AS development, coalesce(s.popular_opinion, b.popular_opinion) AS popular_opinion, coalesce(s.observed_at, b.observed_at) AS observed_at FROM ({_COUNTY_BASE}) b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county_id ORDER BY observed_at DESC, transaction_id DESC) AS r FROM ({_COUNTY_SEEN}) x) WHERE r = 1) s USING (county_id)")
def county_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.observed_counties(run_sql(spark, sf_dir, _COUNTY_BASE), run_sql(spark, sf_dir, _COUNTY_SEEN))


_BARONY_BASE = "SELECT 'run' AS playthrough_id, concat('b_', c_custkey) AS barony_id, 'c_0' AS county_id, 'd_0' AS duchy_id, c_name AS barony_name, 'castle' AS holding_type, 'ruler' AS holder_type, c_acctbal AS tax, CAST(NULL AS DOUBLE) AS levies, CAST(1 AS DOUBLE) AS plague_resistance, CAST(3 AS DOUBLE) AS garrison, false AS is_county_capital, 'base' AS observed_at FROM customer WHERE c_acctbal > 0"
_BARONY_SEEN = "SELECT 'seen' AS playthrough_id, concat('b_', o_custkey) AS barony_id, 'c_1' AS county_id, 'd_1' AS duchy_id, concat('n', o_custkey) AS barony_name, CASE WHEN o_orderkey % 2 = 0 THEN 'city' END AS holding_type, 'vassal' AS holder_type, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS tax, CAST(o_orderkey % 50 AS DOUBLE) AS levies, CAST(NULL AS DOUBLE) AS plague_resistance, concat('', o_orderdate) AS observed_at, o_orderkey AS transaction_id FROM orders"
_BARONY_SLOTS = "SELECT concat('b_', c_custkey) AS barony_id, c_custkey % 2 = 0 AS is_county_capital FROM customer"


@own("D41_barony_overlay", f"""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY barony_id ORDER BY observed_at DESC, transaction_id DESC) AS r FROM ({_BARONY_SEEN}) x) WHERE r = 1), b AS ({_BARONY_BASE})
SELECT b.playthrough_id, b.barony_id, b.county_id, b.duchy_id, b.barony_name, coalesce(s.holding_type, b.holding_type) AS holding_type, coalesce(s.holder_type, b.holder_type) AS holder_type, coalesce(s.tax, b.tax) AS tax, coalesce(s.levies, b.levies) AS levies, coalesce(s.plague_resistance, b.plague_resistance) AS plague_resistance, b.garrison, b.is_county_capital, coalesce(s.observed_at, b.observed_at) AS observed_at FROM b LEFT JOIN s USING (barony_id)
UNION ALL SELECT playthrough_id, barony_id, county_id, duchy_id, barony_name, holding_type, holder_type, tax, levies, plague_resistance, NULL, z.is_county_capital, observed_at FROM s JOIN ({_BARONY_SLOTS}) z USING (barony_id) WHERE barony_id NOT IN (SELECT barony_id FROM b)""")
def barony_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.observed_baronies(*(run_sql(spark, sf_dir, q) for q in (_BARONY_BASE, _BARONY_SEEN, _BARONY_SLOTS)))


@own("W2_latest_of_any_status", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.latest(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


# --- readiness

_PARSER_ROWS = ", ".join(f"({k}, '{name}', '{version}')" for k, (name, version) in enumerate(sorted(readiness.PARSERS.items())))
_PARSER_RUNS = f"SELECT name AS parser_name, concat('run_', event_id) AS parser_run_id, CASE WHEN user_id % 9 = 0 THEN 'old' ELSE version END AS parser_version, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS started_at FROM events JOIN (VALUES {_PARSER_ROWS}) p(i, name, version) ON user_id % 12 = i"
_LATEST = f"SELECT parser_name, parser_run_id, parser_version, status FROM (SELECT *, row_number() OVER (PARTITION BY parser_name ORDER BY started_at DESC, parser_run_id DESC) AS r FROM ({_PARSER_RUNS}) x) y WHERE r = 1"
_FILES = f"SELECT name AS source_group, concat(doc_id, '.txt') AS relative_path, concat('sha', doc_id) AS sha256, n_chars AS byte_size, 'then' AS modified_at, CASE WHEN i < 6 OR doc_id % 3 = 0 THEN l.parser_run_id ELSE 'run_0' END AS parser_run_id FROM documents JOIN (VALUES {_PARSER_ROWS}) p(i, name, version) ON doc_id % 10 = i LEFT JOIN ({_LATEST}) l ON l.parser_name = name"
_EVIDENCE = {
    "baseline": "SELECT 'candidate' AS support_status, false AS historical_state_complete, 'reviewed' AS review_status, '1.19' AS game_version, '' AS steam_build_id",
    "parser_runs": _PARSER_RUNS, "source_files": _FILES,
    "titles": "SELECT concat('d_', c_custkey) AS title_id, c_custkey % 97 <> 0 AS selectable, CASE WHEN c_custkey % 97 = 0 OR c_custkey % 101 = 0 THEN 'warning' ELSE 'valid' END AS validation_status, CASE WHEN c_custkey % 97 = 0 THEN 'non-canonical rank chain: de' WHEN c_custkey % 89 = 0 THEN 'duplicate title declarations' END AS validation_note, concat('p', c_custkey + CASE WHEN c_custkey % 50 = 0 THEN 10000000 ELSE 0 END) AS localization_key FROM customer",
    "title_blocks": "SELECT concat('d_', o_custkey) AS title_id, CASE WHEN o_orderstatus = 'F' THEN 'conflicting_at_baseline' ELSE 'unique' END AS classification FROM orders",
    "character_blocks": "SELECT concat('h', s_suppkey) AS character_id, 'unique' AS classification FROM supplier",
    "title_states": "SELECT concat('d_', o_orderkey) AS title_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'not evaluated: effect' END AS validation_note, CASE WHEN o_orderkey % 77 = 0 THEN 'unresolved' ELSE 'declared_static' END AS capital_status, o_orderpriority AS government_id FROM orders",
    "character_states": "SELECT concat('h', c_custkey) AS character_id, CASE WHEN c_acctbal < -990 THEN 'x; not evaluated: effect' END AS validation_note, c_mktsegment AS culture_id, concat('f', c_nationkey) AS faith_id, CASE WHEN c_custkey % 3 = 0 THEN concat('', c_custkey % 40) END AS dynasty_id, concat('house_', c_nationkey) AS dynasty_house_id FROM customer",
    "holders": "SELECT concat('t', c_custkey) AS title_id, CASE WHEN c_acctbal < 0 THEN 'warning' ELSE 'valid' END AS validation_status FROM customer",
    "bookmark_links": "SELECT r_name AS bookmark_id, 'valid' AS validation_status FROM region", "bookmark_characters": "SELECT r_name AS bookmark_id, CASE WHEN n_nationkey % 2 = 0 THEN 'featured' ELSE 'related' END AS character_kind, CASE WHEN n_nationkey % 3 = 1 THEN 'warning' ELSE 'valid' END AS validation_status FROM nation JOIN region ON n_regionkey = r_regionkey",
    "requirements": "SELECT n_name AS requirement_value, CASE WHEN n_nationkey % 11 = 0 THEN 'raw_flag' ELSE 'resolved' END AS resolution_status, CASE WHEN n_nationkey % 11 <> 0 THEN concat('pkg', n_regionkey) END AS resolved_package_id FROM nation", "packages": "SELECT concat('pkg', r_regionkey) AS package_id, CASE WHEN r_regionkey = 4 THEN 'warning' ELSE 'valid' END AS validation_status FROM region",
    "labels": "SELECT concat('p', p_partkey) AS localization_key FROM part",
    "nicknames": "SELECT concat('nick_', s_suppkey) AS nickname_id, CASE s_suppkey % 20 WHEN 0 THEN 'warning' WHEN 1 THEN 'reviewed_orphan' ELSE 'valid' END AS validation_status, 'english' AS localization_language, concat('nick_', s_suppkey) AS localization_key, CASE WHEN s_suppkey % 13 <> 0 THEN s_name END AS display_name, 'a.yml' AS localization_source_path, 1 AS localization_source_line FROM supplier",
    "used_nicknames": "SELECT concat('nick_', c_custkey % 120) AS nickname_id FROM customer",
    "wiki_pages": "SELECT * FROM (VALUES ('government', 'u', 'p', '1', '2026', '1.19', 'reviewed'), ('culture', 'u', '', '1', '2026', '1.19', 'reviewed'), ('faith', 'u', 'p', '1', CAST(NULL AS varchar(40)), '1.19', 'reviewed'), ('dynasty', 'u', 'p', '1', '2026', '1.19', 'candidate'), ('house', 'u', 'p', '2', '2026', '1.19', 'reviewed')) w(page_key, canonical_url, permanent_url, revision_id, retrieved_at, stated_game_version, review_status)",
    "governments": "SELECT DISTINCT o_orderpriority AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'warning' ELSE 'valid' END AS validation_status FROM orders", "cultures": "SELECT DISTINCT c_mktsegment AS id, 'valid' AS validation_status FROM customer",
    "faiths": "SELECT concat('f', n_nationkey) AS id, 'valid' AS validation_status FROM nation WHERE n_regionkey <> 2", "dynasties": "SELECT concat('', s_suppkey) AS id, 'valid' AS validation_status FROM supplier", "houses": "SELECT concat('house_', n_nationkey) AS id, 'valid' AS validation_status FROM nation",
}


def evidence(spark: SparkSession, sf_dir: str) -> readiness.Evidence:
    return readiness.Evidence(**{name: run_sql(spark, sf_dir, q) for name, q in _EVIDENCE.items()})


def _lacks(used: str, column: str, catalog: str) -> str:
    return f"(SELECT count(DISTINCT {column}) FROM ({_EVIDENCE[used]}) u WHERE {column} NOT IN (SELECT id FROM ({_EVIDENCE[catalog]}) c WHERE validation_status = 'valid'))"


def _one(table: str, what: str) -> str:
    return f"(SELECT {what} FROM ({_EVIDENCE[table]}) x)"


_WRONG_RUNS = f"(SELECT count(*) FROM (VALUES {_PARSER_ROWS}) p(i, name, version) LEFT JOIN ({_LATEST}) l ON parser_name = name WHERE parser_run_id IS NULL OR status <> 'completed' OR parser_version <> version)"
_WRONG_FILES = f"(SELECT count(*) FROM (SELECT name, l.parser_run_id AS latest, count(f.source_group) AS n, count(*) FILTER (WHERE f.parser_run_id = l.parser_run_id) AS bound FROM (VALUES {_PARSER_ROWS}) p(i, name, version) LEFT JOIN ({_LATEST}) l ON parser_name = name LEFT JOIN ({_FILES}) f ON f.source_group = name GROUP BY ALL) g WHERE n = 0 OR latest IS NULL OR bound <> n)"
_GOOD_NICK = "validation_status = 'valid' AND display_name IS NOT NULL"
_NICK_BAD = _one("nicknames", "count(*) FILTER (WHERE validation_status IN ('warning', 'reviewed_orphan'))") + f" + (SELECT count(DISTINCT nickname_id) FROM ({_EVIDENCE['used_nicknames']}) u WHERE nickname_id NOT IN (SELECT nickname_id FROM ({_EVIDENCE['nicknames']}) n WHERE {_GOOD_NICK}))"
_GATES = f"(SELECT count(DISTINCT requirement_value) FROM ({_EVIDENCE['requirements']}) r WHERE resolution_status <> 'resolved' OR resolved_package_id NOT IN (SELECT package_id FROM ({_EVIDENCE['packages']}) p WHERE validation_status = 'valid'))"
_FEATURED = f"(SELECT count(*) FROM ({_EVIDENCE['bookmark_characters']}) c WHERE character_kind = 'featured' AND validation_status = 'warning')"
#: code, class where it is true, class otherwise, condition on n, n, shown
_FINDINGS = [
    ("build_identity", "0", "0"), ("required_parsers", _WRONG_RUNS, None), ("source_manifests", _WRONG_FILES, None), ("selectable_hierarchy", _one("titles", "count(*) FILTER (WHERE selectable AND validation_status = 'warning')"), None),
    ("nonselectable_structural_titles", _one("titles", "count(*) FILTER (WHERE NOT selectable AND validation_note LIKE 'non-canonical rank chain:%')"), None), ("duplicate_structural_titles", _one("titles", "count(*) FILTER (WHERE validation_note = 'duplicate title declarations')"), None),
    ("duplicate_title_history", _one("title_blocks", "count(DISTINCT title_id) FILTER (WHERE classification = 'conflicting_at_baseline')"), None), ("opaque_title_history", _one("title_states", "count(*) FILTER (WHERE validation_note LIKE '%not evaluated:%')"), None),
    ("character_history_review", _one("character_states", "count(*) FILTER (WHERE validation_note LIKE '%not evaluated:%')"), None), ("holder_lifecycle", _one("holders", "count(*) FILTER (WHERE validation_status = 'warning')"), None),
    ("bookmark_profile", f"(CASE WHEN {_FEATURED} = 0 THEN (SELECT count(*) FROM region) ELSE 0 END)", "(SELECT count(*) FROM region)"), ("bookmark_dlc_resolution", _GATES, None), ("capital_resolution", _one("title_states", "count(*) FILTER (WHERE capital_status IN ('unresolved', 'not_evaluated'))"), None),
    ("selectable_localization", f"(SELECT count(*) FROM ({_EVIDENCE['titles']}) t WHERE selectable AND localization_key NOT IN (SELECT localization_key FROM ({_EVIDENCE['labels']}) l))", None), ("nickname_catalog", f"({_NICK_BAD})", None), ("nickname_catalog_orphans", _one("nicknames", "count(*) FILTER (WHERE validation_status = 'reviewed_orphan')"), None),
    ("wiki_provenance", "1", None), ("government_catalog", _lacks("title_states", "government_id", "governments"), None), ("culture_wiki_provenance", "0", None), ("culture_catalog", _lacks("character_states", "culture_id", "cultures"), None), ("faith_wiki_provenance", "0", None),
    ("faith_catalog", _lacks("character_states", "faith_id", "faiths"), None), ("dynasty_wiki_provenance", "0", None), ("dynasty_catalog", _lacks("character_states", "dynasty_id", "dynasties"), None), ("house_wiki_provenance", "1", None), ("house_catalog", _lacks("character_states", "dynasty_house_id", "houses"), None), ("promotion_gate", "0", None),
]


def _finding(order: int, code: str, n: str, shown: str | None) -> str:
    some, none = readiness.MODES[readiness.RULES[order - 1][1]]
    return f"SELECT {order} AS finding_order, '{code}' AS code, CASE WHEN n > 0 THEN '{some}' ELSE '{none}' END AS classification, CAST({shown or 'n'} AS BIGINT) AS subject_count FROM (SELECT {n} AS n) f{order}"


#: Rules that show another count when they pass.
_PASS_COUNTS = {"required_parsers": "CASE WHEN n > 0 THEN n ELSE 11 END", "source_manifests": f"CASE WHEN n > 0 THEN n ELSE (SELECT count(*) FROM ({_FILES}) f) END", "nickname_catalog": "CASE WHEN n > 0 THEN n ELSE 120 END", "bookmark_dlc_resolution": "CASE WHEN n > 0 THEN n ELSE 0 END"}
FINDINGS_SQL = " UNION ALL ".join(_finding(k, code, n, shown or _PASS_COUNTS.get(code)) for k, (code, n, shown) in enumerate(_FINDINGS, 1))


@own("D33_readiness", FINDINGS_SQL)
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.findings(evidence(spark, sf_dir)).select("finding_order", "code", "classification", "subject_count")


@own("D33_details", f"""SELECT 'build_identity' AS code, 'Installed build identity is incomplete' AS summary, 'Game 1.19, Steam build unknown.' AS detail
UNION ALL SELECT 'bookmark_profile', 'Bookmark profile is incomplete', concat((SELECT count(*) FROM region), ' themed collections; ', {_FEATURED}, ' unresolved direct featured rulers.') UNION ALL SELECT 'promotion_gate', 'Promotion remains an explicit operation', 'Current statuses: snapshot=reviewed, baseline=candidate, historical_state_complete=false.'
UNION ALL SELECT 'character_history_review', CASE WHEN n > 0 THEN 'Character history requires review' ELSE 'Character history is fully resolved' END, concat('0 duplicate IDs and ', n, ' baseline-effective opaque states.') FROM (SELECT {_one("character_states", "count(*) FILTER (WHERE validation_note LIKE '%not evaluated:%')")} AS n) c
UNION ALL SELECT 'required_parsers', 'Required parser runs are not current', string_agg(CASE WHEN parser_run_id IS NULL THEN concat(name, ': missing') WHEN status <> 'completed' THEN concat(name, ': latest status ', status) ELSE concat(name, ': expected ', version, ', latest ', parser_version) END, '; ' ORDER BY name) FROM (VALUES {_PARSER_ROWS}) p(i, name, version) LEFT JOIN ({_LATEST}) l ON parser_name = name WHERE parser_run_id IS NULL OR status <> 'completed' OR parser_version <> version HAVING count(*) > 0""")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ("build_identity", "bookmark_profile", "promotion_gate", "character_history_review", "required_parsers")
    return readiness.findings(evidence(spark, sf_dir)).where(F.col("code").isin(*shown)).select("code", "summary", "detail")


@own("A21_tallies", f"SELECT count(*) FILTER (WHERE classification = 'blocking') AS blocking, count(*) FILTER (WHERE classification = 'accepted_exception') AS accepted_exception, count(*) FILTER (WHERE classification = 'informational') AS informational, count(*) FILTER (WHERE classification = 'passed') AS passed, 'blocked' AS overall_status FROM ({FINDINGS_SQL}) f")
def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.tallies(readiness.findings(evidence(spark, sf_dir)))


_BEFORE = _PARSER_RUNS.replace("FROM events JOIN", "FROM (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-28 00:00:00') e JOIN")
_LATEST_BEFORE = _LATEST.replace(_PARSER_RUNS, _BEFORE)


@own("D34_stale_bindings", f"""SELECT CASE WHEN names IS NULL THEN 'current' ELSE 'stale' END AS evidence_status, CASE WHEN names IS NULL THEN 'Report evidence matches the current parser runs and manifests.' ELSE concat('Evidence changed for: ', names, '.') END AS evidence_detail
FROM (SELECT string_agg(name, ', ' ORDER BY name) FILTER (WHERE (a.parser_run_id, a.parser_version, a.status) IS DISTINCT FROM (b.parser_run_id, b.parser_version, b.status)) AS names FROM (VALUES {_PARSER_ROWS}) p(i, name, version) LEFT JOIN ({_LATEST}) a ON a.parser_name = name LEFT JOIN ({_LATEST_BEFORE}) b ON b.parser_name = name) x""")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run_sql(spark, sf_dir, _FILES)
    return readiness.changed_bindings(readiness.bindings(run_sql(spark, sf_dir, _BEFORE), files), readiness.bindings(run_sql(spark, sf_dir, _PARSER_RUNS), files))


@own("D34_bindings", f"SELECT name AS parser_name, l.parser_run_id, l.parser_version, coalesce(l.status, 'missing') AS parser_status, (SELECT count(*) FROM ({_FILES}) f WHERE source_group = name) AS manifest_count FROM (VALUES {_PARSER_ROWS}) p(i, name, version) LEFT JOIN ({_LATEST}) l ON l.parser_name = name")
def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.bindings(run_sql(spark, sf_dir, _PARSER_RUNS), run_sql(spark, sf_dir, _FILES)).drop("manifest_digest")


_MANIFEST = ["relative_path", "sha256", "byte_size", "modified_at", "parser_run_id"]
#: The manifests as they were: another content in one file of each of two parsers, and one file more of a third.
_FILES_BEFORE = f"""SELECT source_group, relative_path, CASE WHEN source_group IN ('installed_landed_titles', 'installed_faiths') AND relative_path = least_path THEN 'other' ELSE sha256 END AS sha256, byte_size, modified_at, parser_run_id
FROM (SELECT *, min(relative_path) OVER (PARTITION BY source_group) AS least_path FROM ({_FILES}) f) g UNION ALL SELECT 'installed_cultures', concat(r_name, '.txt'), 'sha', r_regionkey, 'then', 'run_0' FROM region WHERE r_regionkey = 0"""


def _manifests(files: str) -> str:
    said = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _MANIFEST)
    return f"SELECT source_group, n, sha256 AS d FROM ({tree_sql(f'SELECT source_group, {said} FROM ({files}) f', _MANIFEST, ['relative_path'], ['source_group'], 2)[-1]}) t"


@own("D34_manifest_digests", f"SELECT name AS parser_name, coalesce(n, 0) AS manifest_count, coalesce(d, sha256('')) AS manifest_digest FROM (VALUES {_PARSER_ROWS}) p(i, name, version) LEFT JOIN ({_manifests(_FILES)}) m ON source_group = name")
def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.bindings(run_sql(spark, sf_dir, _PARSER_RUNS), run_sql(spark, sf_dir, _FILES)).select("parser_name", "manifest_count", "manifest_digest")


@own("D34_changed_manifests", f"SELECT 'stale' AS evidence_status, concat('Evidence changed for: ', string_agg(name, ', ' ORDER BY name), '.') AS evidence_detail FROM (VALUES {_PARSER_ROWS}) p(i, name, version) LEFT JOIN ({_manifests(_FILES)}) m ON m.source_group = name LEFT JOIN ({_manifests(_FILES_BEFORE)}) b ON b.source_group = name WHERE m.d IS DISTINCT FROM b.d")
def changed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run_sql(spark, sf_dir, _PARSER_RUNS)
    return readiness.changed_bindings(readiness.bindings(runs, run_sql(spark, sf_dir, _FILES_BEFORE)), readiness.bindings(runs, run_sql(spark, sf_dir, _FILES)))




_REPORTS = "SELECT concat('r', o_orderkey) AS report_id, concat('b', o_orderkey % 3) AS baseline_id, o_orderdate AS generated_at FROM orders"
_REPORT_FINDINGS = "SELECT concat('r', l_orderkey) AS report_id, l_linenumber AS finding_order, concat('code_', l_partkey) AS code, CASE l_returnflag WHEN 'R' THEN 'blocking' WHEN 'A' THEN 'accepted_exception' ELSE 'passed' END AS classification, CAST(l_quantity AS BIGINT) AS subject_count, 's' AS summary, 'd' AS detail FROM lineitem"


def _latest_report(baseline: str, status: str, held: int) -> str:
    return f"""WITH n AS (SELECT * FROM ({_REPORTS}) r WHERE baseline_id = '{baseline}' ORDER BY generated_at DESC, report_id DESC LIMIT 1)
SELECT n.report_id, count(*) FILTER (WHERE classification = 'blocking') AS blocking, count(*) FILTER (WHERE classification = 'accepted_exception') AS accepted_exception, CAST(0 AS BIGINT) AS informational, count(*) FILTER (WHERE classification = 'passed') AS passed, CASE WHEN count(*) FILTER (WHERE classification = 'blocking') > 0 THEN 'blocked' ELSE 'ready_for_review' END AS overall_status,
string_agg(concat(finding_order, ':', code), ',' ORDER BY finding_order, code) AS findings, '{status}' AS evidence_status, CAST({held} AS BIGINT) AS evidence_binding_count FROM n JOIN ({_REPORT_FINDINGS}) f USING (report_id) GROUP BY ALL"""


def _report(spark: SparkSession, sf_dir: str, stored: DataFrame, current: DataFrame, baseline: str) -> DataFrame:
    rows = readiness.latest_report(run_sql(spark, sf_dir, _REPORTS), run_sql(spark, sf_dir, _REPORT_FINDINGS), stored, current, baseline)
    listed = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["finding_order"], x["code"])), ",")
    return rows.select("report_id", *readiness.CLASSES, "overall_status", listed.alias("findings"), "evidence_status", "evidence_binding_count")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.bindings(run_sql(spark, sf_dir, _PARSER_RUNS), run_sql(spark, sf_dir, _FILES))


@own("D48_latest_report", _latest_report("b1", "stale", 0))
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _current(spark, sf_dir)
    return _report(spark, sf_dir, current.where("false").select(F.lit("r").alias("report_id"), "*"), current, "b1")


@own("D48_current_report", _latest_report("b2", "current", len(readiness.PARSERS)))
def current_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings stored with every report of the baseline, the same as those of now."""
    current = _current(spark, sf_dir)
    reports = run_sql(spark, sf_dir, _REPORTS).where("baseline_id = 'b2'").select("report_id")
    return _report(spark, sf_dir, reports.crossJoin(F.broadcast(current)), current, "b2")  # one binding a parser


# --- freezing

_STATES = "SELECT concat('h', c_custkey) AS character_id, 'warning' AS validation_status, c_name AS validation_note, c_mktsegment AS culture_id FROM customer WHERE c_acctbal < 0"
_DECLARED = f"SELECT concat('h', o_custkey) AS character_id, o_orderkey AS declaration_order, {day('o_orderdate')} AS effective_date, CASE WHEN o_orderkey % 3 = 0 THEN 'name' ELSE 'effect' END AS operation_key, CASE WHEN o_orderstatus = 'F' THEN 'preserved' ELSE 'normalized' END AS resolution_status, concat('f', o_custkey % 30, '.txt') AS source_path, '1' AS parser_version, concat('{{ a = ', o_orderkey, ' b = {{ c = x }} }}') AS raw_script FROM orders"
_SOURCES = "SELECT 'installed_character_history' AS source_group, concat('f', n_nationkey, '.txt') AS relative_path, concat('sha', n_nationkey) AS sha256, CASE WHEN n_nationkey = 7 THEN 'run_0' ELSE 'run_1' END AS parser_run_id FROM nation"


def unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = spark.createDataFrame([("installed_character_history", "run_1", "1")], "parser_name string, parser_run_id string, parser_version string")
    return freeze.unread(run_sql(spark, sf_dir, _DECLARED), run_sql(spark, sf_dir, _SOURCES), bound, run_sql(spark, sf_dir, _STATES), PEOPLE)


_UNREAD = f"SELECT d.*, s.sha256 AS source_sha256 FROM ({_DECLARED}) d JOIN ({_SOURCES}) s ON relative_path = source_path AND s.parser_run_id = 'run_1' WHERE operation_key = 'effect' AND resolution_status = 'preserved' AND effective_date <= {PEOPLE} AND character_id IN (SELECT character_id FROM ({_STATES}) w)"


@own("D35_F13_unread_shapes", f"SELECT character_id, declaration_order, source_sha256, 'a=<scalar>+b{{c=<scalar>}}' AS shape, sha256(raw_script) AS raw_sha256 FROM ({_UNREAD}) u")
def unread_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.shaped(unread(spark, sf_dir)).select("character_id", "declaration_order", "source_sha256", "shape", "raw_sha256")


@own("D35_ledger_counts", f"SELECT w.character_id, validation_note, count(u.character_id) AS declaration_count FROM ({_STATES}) w LEFT JOIN ({_UNREAD}) u ON u.character_id = w.character_id GROUP BY ALL")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = freeze.ledger(unread(spark, sf_dir), run_sql(spark, sf_dir, _STATES))
    return rows.select("character_id", "validation_note", F.coalesce("declaration_count", F.lit(0)).alias("declaration_count"))


_TREE = "SELECT concat('f', n_nationkey, '.txt') AS path, CASE WHEN n_nationkey % 6 = 0 THEN 'other' ELSE concat('sha', n_nationkey) END AS content_sha256, 'file' AS kind FROM nation"


@own("D35_freeze_problems", f"""SELECT 'Readiness report is already frozen' AS rule, 'report' AS subject UNION ALL SELECT 'Steam build evidence does not match the snapshot', '2' UNION ALL SELECT 'Readiness finding does not match live character warnings', CAST((SELECT count(*) FROM ({_STATES}) s) AS VARCHAR)
UNION ALL SELECT DISTINCT 'Parser and full-tree hashes differ', source_path FROM ({_UNREAD}) u WHERE (source_path, source_sha256) NOT IN (SELECT path, content_sha256 FROM ({_TREE}) t)
UNION ALL SELECT 'Warning subjects and preserved declarations do not reconcile', character_id FROM ({_STATES}) w WHERE character_id NOT IN (SELECT character_id FROM ({_UNREAD}) u)
UNION ALL SELECT 'Residual character warning ledger changed before freeze', concat((SELECT count(*) FROM ({_STATES}) s), '/', (SELECT count(*) FROM ({_UNREAD}) u))""")
def freeze_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = spark.createDataFrame([("blocked", True, -1, "1", "2", "v", "v")], "overall_status string, frozen boolean, subject_count long, steam_build_id string, found_build_id string, game_version string, found_game_version string")
    return freeze.problems(report, run_sql(spark, sf_dir, _STATES), unread(spark, sf_dir), run_sql(spark, sf_dir, _TREE), {"files": 25, "directories": 0, "subjects": -1, "declarations": -1})


_DIGESTED = "SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS said FROM orders"


@own("A19_ordered_digest", f"SELECT o_custkey, n, sha256 FROM ({tree_sql(_DIGESTED, ['o_orderkey', 'o_orderstatus', 'said'], ['o_orderkey'], ['o_custkey'], 4)[-1]}) t")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of groups of rows, whatever the order of the rows, which are shuffled here."""
    return freeze.digest(run_sql(spark, sf_dir, _DIGESTED).repartition(3, "said"), ["o_orderkey"], ["o_custkey"])


#: A manifest of paths and its later state: some paths gone, some with other bytes, some new.
_PATHS = "SELECT concat('f/', o_orderkey, '.txt') AS path, concat(o_orderstatus, o_custkey) AS content FROM orders"
_PATHS_LATER = "SELECT concat('f/', o_orderkey, '.txt') AS path, CASE WHEN o_orderkey % 89 = 0 THEN 'other' ELSE concat(o_orderstatus, o_custkey) END AS content FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT concat('g/', c_custkey), c_name FROM customer WHERE c_custkey % 10 = 0"


@own("A19_manifest_tree", " UNION ALL ".join(tree_sql(_PATHS, ["path", "content"], ["path"], [], 4)))
def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree(run_sql(spark, sf_dir, _PATHS), ["path"])


@own("U7_manifest_changes", f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_PATHS}) a FULL JOIN ({_PATHS_LATER}) b ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content")
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = run_sql(spark, sf_dir, _PATHS), run_sql(spark, sf_dir, _PATHS_LATER)
    return trees.differences(old, new, trees.tree(old, ["path"]), trees.tree(new, ["path"]), ["path"])


_DEFINED = "SELECT concat('t', n_nationkey) AS id, CASE WHEN n_nationkey % 8 = 0 THEN 'moved.txt' ELSE 'a.txt' END AS path, concat('sha', n_nationkey) AS raw_sha256 FROM nation"
_LEVELS = "SELECT concat('t', n_nationkey) AS id, r_regionkey AS level_index, concat('l', CASE WHEN n_nationkey = 11 THEN 4 - r_regionkey ELSE r_regionkey END) AS level_id FROM nation, region"
_USES = "SELECT concat('t', n_nationkey) AS id, CASE WHEN n_nationkey % 9 = 4 THEN 'new.txt' ELSE 'use.txt' END AS path FROM nation"


@own("D50_certified", """SELECT 'definition changed' AS rule, concat('t', n_nationkey) AS subject FROM nation WHERE n_nationkey % 8 = 0 UNION ALL SELECT 'levels changed', 't11' UNION ALL SELECT 'consumers changed', concat('t', n_nationkey, ':', p) FROM nation, (VALUES ('new.txt'), ('use.txt')) x(p) WHERE n_nationkey % 9 = 4""")
def certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = run_sql(spark, sf_dir, "SELECT concat('t', n_nationkey) AS id, 'a.txt' AS path, concat('sha', n_nationkey) AS raw_sha256, array('l0', 'l1', 'l2', 'l3', 'l4') AS levels FROM nation")
    allowed = run_sql(spark, sf_dir, "SELECT concat('t', n_nationkey) AS id, 'use.txt' AS path FROM nation")
    return freeze.certified(*(run_sql(spark, sf_dir, q) for q in (_DEFINED, _LEVELS, _USES)), expected, allowed)


@own("D32_catalog_labels", "SELECT concat('p', c_custkey) AS id, p_name AS display_name, CASE WHEN p_name IS NOT NULL AND NOT e THEN 'valid' WHEN e AND p_name IS NULL THEN 'reviewed_orphan' ELSE 'missing' END AS validation_status FROM (SELECT c_custkey, p_name, c_acctbal < -900 AS e FROM customer LEFT JOIN part ON p_partkey = c_custkey AND p_size > 5) x")
def catalog_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT concat('p', c_custkey) AS id FROM customer")
    labels = run_sql(spark, sf_dir, "SELECT concat('p', p_partkey) AS localization_key, p_name AS display_name FROM part WHERE p_size > 5")
    return freeze.catalog_labels(rows, labels, run_sql(spark, sf_dir, "SELECT concat('p', c_custkey) AS id FROM customer WHERE c_acctbal < -900"))[0]


# --- read models

_PROFILE = {
    "baseline": "SELECT '0867-01-01' AS baseline_date, 'candidate' AS support_status, false AS historical_state_complete, 's' AS reference_snapshot_id", "snapshot": "SELECT 's' AS reference_snapshot_id, '1.19' AS game_version, '7' AS steam_build_id",
    "titles": "SELECT concat('t', o_orderkey) AS title_id, o_orderpriority AS display_name, 'county' AS title_rank, concat('d', o_custkey) AS parent_title_id, o_orderstatus = 'F' AS selectable, CASE WHEN o_orderkey % 9 = 0 THEN 'warning' ELSE 'valid' END AS validation_status, CAST(NULL AS varchar(40)) AS validation_note FROM orders",
    "states": "SELECT concat('t', l_orderkey) AS title_id, concat('h', max(l_suppkey)) AS holder, 'declared' AS holder_status, CASE WHEN max(l_linenumber) > 5 THEN 'not_evaluated' ELSE 'declared_static' END AS capital_status, CASE WHEN max(l_quantity) > 49 THEN 'warning' ELSE 'valid' END AS validation_status, 'not evaluated: effect' AS validation_note FROM lineitem GROUP BY l_orderkey",
    "validations": "SELECT concat('t', l_orderkey) AS title_id, 'found' AS declaration_status, CASE WHEN min(l_quantity) < 2 THEN 'warning' ELSE 'valid' END AS validation_status, 'holder lifecycle is unknown' AS validation_note FROM lineitem GROUP BY l_orderkey",
    "adjudications": "SELECT concat('t', c_custkey) AS title_id, concat('h', c_nationkey) AS resolved_id, 'immediate_save' AS evidence_kind, CASE WHEN c_acctbal > 0 THEN 'reviewed' ELSE 'candidate' END AS review_status FROM customer",
    "de_jure": "SELECT concat('t', p_partkey) AS title_id, p_brand AS de_jure_liege FROM part", "tributaries": "SELECT concat('t', s_suppkey) AS title_id, s_name AS suzerain, 'g' AS contract_group FROM supplier", "names": "SELECT concat('t', n_nationkey) AS title_id, n_name AS localization_key, lower(n_name) AS display_name FROM nation",
    "characters": "SELECT concat('h', s_suppkey) AS character_id, s_name AS display_name, 'male' AS sex, concat('cu', s_nationkey) AS culture_id, CASE WHEN s_acctbal < 0 THEN 'warning' ELSE 'valid' END AS validation_status, '' AS validation_note FROM supplier",
}


@own("J3_inspection", f"""SELECT t.title_id, t.selectable, game_version, coalesce(a.resolved_id, ts.holder) AS holder_character_id, ts.holder AS declared, a.evidence_kind, dj.de_jure_liege, tr.suzerain, n.display_name AS override, hv.declaration_status, cs.display_name AS holder_name,
concat_ws('; ', CASE WHEN t.validation_status = 'warning' THEN 'Hierarchy: review required' END, CASE WHEN ts.validation_status = 'warning' THEN concat('Title history: ', ts.validation_note) END, CASE WHEN hv.validation_status = 'warning' THEN concat('Holder: ', hv.validation_note) END, CASE WHEN cs.validation_status = 'warning' THEN 'Character: review required' END, CASE WHEN capital_status = 'not_evaluated' THEN 'Capital: static and scripted capital resolution is not loaded yet' END) AS warnings
FROM ({_PROFILE["titles"]}) t JOIN ({_PROFILE["baseline"]}) b ON true JOIN ({_PROFILE["snapshot"]}) s USING (reference_snapshot_id) LEFT JOIN ({_PROFILE["states"]}) ts ON ts.title_id = t.title_id LEFT JOIN ({_PROFILE["validations"]}) hv ON hv.title_id = t.title_id LEFT JOIN ({_PROFILE["adjudications"]}) a ON a.title_id = t.title_id AND a.review_status = 'reviewed'
LEFT JOIN ({_PROFILE["de_jure"]}) dj ON dj.title_id = t.title_id LEFT JOIN ({_PROFILE["tributaries"]}) tr ON tr.title_id = t.title_id LEFT JOIN ({_PROFILE["names"]}) n ON n.title_id = t.title_id LEFT JOIN ({_PROFILE["characters"]}) cs ON cs.character_id = coalesce(a.resolved_id, ts.holder)""")
def title_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inspection.titles(inspection.Profile(**{name: run_sql(spark, sf_dir, q) for name, q in _PROFILE.items()}))
    return rows.select(
        "title_id", "selectable", "game_version", "holder_character_id", F.col("history_holder").alias("declared"), F.col("adjudicated_evidence_kind").alias("evidence_kind"), "de_jure_liege", "suzerain", F.col("override_display_name").alias("override"),
        F.col("holder_declaration_status").alias("declaration_status"), F.col("character_display_name").alias("holder_name"), F.array_join("warnings", "; ").alias("warnings"),
    )


@own("D36_children", f"SELECT parent_title_id, CAST(row_number() OVER (PARTITION BY parent_title_id ORDER BY display_name, title_id) AS INT) AS position, title_id FROM ({_PROFILE['titles']}) t")
def title_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.children(run_sql(spark, sf_dir, _PROFILE["titles"]))


#: Titles with what is listed under them; every ancestor of a title but those that are missing is in its chain.
_TREE_NODES = f"SELECT title_id, parent_title_id, display_name, substring(title_id, 1, 1) AS title_rank, title_id NOT LIKE '%7' AS selectable, CASE WHEN title_id LIKE '%3' THEN 'warning' ELSE 'valid' END AS validation_status, CAST(NULL AS varchar(40)) AS validation_note FROM ({TITLES}) t WHERE title_id NOT LIKE 'b%'"
_LISTED = {
    "blocks": "SELECT concat('c_', l_orderkey) AS owner, l_linenumber AS source_block_order, concat('f', l_suppkey % 5, '.txt') AS source_path, 'unique' AS duplicate_classification, CAST(NULL AS varchar(40)) AS baseline_conflict_fields, l_linestatus AS resolution_status, l_returnflag = 'R' AS is_winner FROM lineitem",
    "variables": "SELECT concat('c_', o_orderkey) AS owner, concat(name, o_orderpriority) AS variable_name, 'flag' AS value_kind, o_orderstatus AS text_value, o_custkey AS effective_date, o_orderkey AS source_declaration_order, 'valid' AS validation_status, CAST(NULL AS varchar(40)) AS validation_note FROM orders JOIN (SELECT 'b_' AS name UNION ALL SELECT 'a_') v ON o_orderkey % 3 > 0",
    "prestige": "SELECT concat('d_', o_custkey) AS owner, concat('dyn', o_orderkey) AS dynasty_id, o_orderkey % 5 AS minimum_prestige_level, 'minimum' AS value_status, o_orderkey % 4 AS effective_date, CAST(NULL AS varchar(40)) AS source_holder_character_id, o_orderkey AS source_declaration_order, 'h.txt' AS helper_source_path, 'sha' AS helper_raw_sha256, 'valid' AS validation_status, CAST(NULL AS varchar(40)) AS validation_note FROM orders WHERE o_orderkey % 5 = 0",
}
_ACTIVE_LAWS = "SELECT concat('d_', o_custkey) AS title_id, o_orderkey AS law_order, concat('law_', o_orderkey % 30) AS law_id, o_custkey AS effective_date, o_orderkey AS source_declaration_order, 'valid' AS validation_status, CAST(NULL AS varchar(40)) AS validation_note FROM orders WHERE o_orderkey % 3 = 0"
_LAW_DEFINITIONS = "SELECT concat('law_', n_nationkey) AS law_id, concat('group_', n_regionkey) AS law_group_id, 'laws.txt' AS source_path, n_nationkey AS source_line_start, n_nationkey + 3 AS source_line_end FROM nation"
#: What a query shows of each section: (name, columns, order in DuckDB).
_SHOWN = {
    "chain": ("title_id display_name title_rank selectable", "depth DESC"), "children": ("title_id display_name validation_status", "display_name, title_id"), "blocks": ("source_block_order source_path resolution_status is_winner", "source_block_order"),
    "laws": ("law_order law_id law_group_id source_line_end", "law_order"), "variables": ("variable_name text_value effective_date", "variable_name"), "prestige": ("dynasty_id minimum_prestige_level effective_date", "effective_date, source_declaration_order"),
}
_SECTION_PAGE = 5


def _sections_sql() -> str:
    sources = {
        "chain": f"SELECT leaf AS owner, n.*, depth FROM (WITH RECURSIVE up AS (SELECT title_id AS leaf, title_id, parent_title_id, 0 AS depth FROM ({_TREE_NODES}) a UNION ALL SELECT leaf, t.title_id, t.parent_title_id, depth + 1 FROM up JOIN ({_TREE_NODES}) t ON t.title_id = up.parent_title_id) SELECT leaf, title_id AS above, depth FROM up) u JOIN ({_TREE_NODES}) n ON n.title_id = above",
        "children": f"SELECT parent_title_id AS owner, * FROM ({_TREE_NODES}) n WHERE parent_title_id IS NOT NULL",
        "laws": f"SELECT title_id AS owner, a.*, law_group_id, source_line_end FROM ({_ACTIVE_LAWS}) a JOIN ({_LAW_DEFINITIONS}) d USING (law_id)", **_LISTED,
    }
    pages = []
    for name, (columns, order) in _SHOWN.items():
        said = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns.split())
        pages.append(f"SELECT owner, '{name}' AS s, concat_ws('|', {said}) AS said, row_number() OVER (PARTITION BY owner ORDER BY {order}, said) - 1 AS place FROM ({sources[name]}) x_{name}")
    shown = ", ".join(f"coalesce(string_agg(said, ';' ORDER BY place) FILTER (WHERE s = '{name}'), '') AS {name}" for name in _SHOWN)
    return f"SELECT owner, CAST(place // {_SECTION_PAGE} AS INT) AS page, {shown} FROM ({' UNION ALL '.join(pages)}) p GROUP BY ALL"


@own("D36_sections", _sections_sql())
def title_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = run_sql(spark, sf_dir, _TREE_NODES)
    tables = {"chain": inspection.title_chain(nodes), "children": nodes.withColumnRenamed("parent_title_id", "owner"), "laws": inspection.title_laws(run_sql(spark, sf_dir, _ACTIVE_LAWS), run_sql(spark, sf_dir, _LAW_DEFINITIONS)), **{name: run_sql(spark, sf_dir, q) for name, q in _LISTED.items()}}
    rows = inspection.sections(tables, _SECTION_PAGE)

    def said(name: str, columns: list[str]) -> Column:
        return F.array_join(F.transform(name, lambda x: F.concat_ws("|", *[x[c].cast("string") for c in columns])), ";").alias(name)

    return rows.select("owner", "page", *[said(name, columns.split()) for name, (columns, _) in _SHOWN.items()])


_MARKS = "SELECT r_name AS bookmark_id, '0867-01-01' AS effective_start_date FROM region"
_NEEDS = "SELECT r_name AS bookmark_id, n_name AS requirement_value, CASE WHEN n_nationkey % 4 = 0 THEN 'raw_flag' ELSE 'resolved' END AS resolution_status, concat('pkg', n_nationkey % 3) AS resolved_package_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2"
_PACKAGES = "SELECT concat('pkg', r_regionkey) AS package_id, r_name AS display_name FROM region"


@own("A6_rollup_names", f"""SELECT bookmark_id, coalesce(display_value, bookmark_id) AS display_name, effective_start_date, (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = bookmark_id AND n_nationkey % 2 = 0) AS featured_count,
coalesce((SELECT string_agg(DISTINCT x, ', ' ORDER BY x) FROM (SELECT bookmark_id AS b, CASE WHEN resolution_status = 'resolved' THEN concat(display_name, ' [', package_id, ']') ELSE concat(requirement_value, ' [unresolved]') END AS x FROM ({_NEEDS}) n LEFT JOIN ({_PACKAGES}) p ON package_id = resolved_package_id) y WHERE b = bookmark_id), 'Core game') AS dlc_requirements
FROM ({_MARKS}) m LEFT JOIN (SELECT r_name AS localization_key, concat('Label ', r_name) AS display_value FROM region WHERE r_regionkey <> 1) l ON localization_key = bookmark_id""")
def bookmark_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = run_sql(spark, sf_dir, "SELECT r_name AS localization_key, concat('Label ', r_name) AS display_value FROM region WHERE r_regionkey <> 1")
    people = run_sql(spark, sf_dir, "SELECT r_name AS bookmark_id, CASE WHEN n_nationkey % 2 = 0 THEN 'featured' ELSE 'related' END AS character_kind FROM nation JOIN region ON n_regionkey = r_regionkey")
    return inspection.bookmarks(run_sql(spark, sf_dir, _MARKS), labels, people, run_sql(spark, sf_dir, _NEEDS), run_sql(spark, sf_dir, _PACKAGES))
