"""The operators' queries over whole tables, and the corpus pipeline. Registered by __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, clusters, decontamination, html_content, manifest, near_dedup, pieces, quality, repeats, secrets, sharding, transport, wordpiece
from annalist.llm.common import documents

#: Vocabulary files, by the installed package that holds them.
RANKS_FILE, PIECES_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SHARDS = sharding.balanced(2, 2, 4)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.features(transport.store(documents(spark, sf_dir))).select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "status", "continuity_errors", "access_units"
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(RANKS_FILE)
    encoded = bpe.encode(documents(spark, sf_dir), path, pattern())
    return bpe.digests(encoded, path, pattern()).withColumnRenamed("id", "doc_id")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, model)
    return rows.select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir), vocabulary(PIECES_FILE), bare_start=True).withColumnRenamed("id", "doc_id")


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(documents(spark, sf_dir), SHARDS, sharding.grown(SHARDS, 16))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return secrets.scan(documents(spark, sf_dir), ranks_path=vocabulary(RANKS_FILE)).select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", joined.alias("spans"), "n_guess")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the secret scan that SQL expresses: how many base spans of each kind."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op8_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(manifest.tree(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(PIECES_FILE)
    return pieces.digests(pieces.decode(pieces.encode(documents(spark, sf_dir), path), path)).withColumnRenamed("id", "doc_id")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroid = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return clusters.cluster(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", centroid.alias("centroid_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_transport_streams, op2_byte_bpe, op3_quality_model, op4_token_counts, op5_hash_tree, op6_decontamination, op7_secret_scan, op8_html_content, op9_repeated_windows, op10_near_dedup, op11_merkle_manifest, op12_piece_bpe, op13_centroid_clusters, pipeline, secret_base_counts)
    return {f.__name__: f for f in own}


def either_case(word: str) -> str:
    """A pattern of a word in either case of ASCII letters; folding flags would take other letters too."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"({_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"

SECRET_COUNTS = rf"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 6)) as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex
from documents
"""

NEAR_DEDUP = r"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from words),
sized as materialized (select doc_id, len(s) as n from sets),
elements as materialized (select doc_id, unnest(s) as e from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from elements a join elements b on a.e = b.e and a.doc_id < b.doc_id group by all),
links as materialized (
  select a, b from shared join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
pairs as materialized (select a, b from links union all select b, a from links),
reach as (select a as node, a as seen from pairs union select r.node, pairs.b from reach r join pairs on pairs.a = r.seen),
least as (select node, min(seen) as component_id from reach group by node)
select z.doc_id, z.n as n_shingles, coalesce(l.component_id, z.doc_id) as component_id, z.doc_id = coalesce(l.component_id, z.doc_id) as kept
from sized z left join least l on l.node = z.doc_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"


def _merkle(source_levels: int = 7, top_levels: int = 4) -> str:
    """Levels are unrolled; a tree with fewer passes its root through. 16**7 rows a source and 16**4 sources are enough for the tables at hand."""

    def level(k: int, of: str) -> str:
        """Runs of level k, and level k + 1."""
        return f"""
{of}r{k} as materialized (select tree, i // 16 as r, n, list(d order by i) as ds from {of}{k} group by all),
{of}{k + 1} as materialized (select tree, r as i, (n + 15) // 16 as n, case when n = 1 then ds[1] else sha256(array_to_string(ds, '')) end as d from {of}r{k}),"""

    def climb(at: int, k: int, of: str) -> str:
        """Each leaf's fold and its siblings, one level up."""
        before, after = "array_to_string(ds[1 : pos % 16], '')", "array_to_string(ds[pos % 16 + 2 :], '')"
        return f"""
w{at + 1} as (select w.* exclude (pos, have, proof), pos // 16 as pos, case when n = 1 then have else sha256({before} || have || {after}) end as have,
  case when n = 1 then proof else proof || {before} || {after} end as proof from w{at} w join {of}r{k} on {of}r{k}.tree = {'w.tree' if of == 'a' else '0'} and r = pos // 16),"""

    fixed = ", ".join(_field(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(list_prepend({x}, range(8)::bigint[]), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda h, c: {step.format(x='xor(h, c)')}), 4294967295)"
    return f"""
with leaves as materialized (
  select doc_id, source, dense_rank() over (order by source nulls first) - 1 as tree, sha256(concat({fixed}, {_field('text')})) as leaf,
    case when coalesce({crc} % 5 = 0, false) then sha256(concat({fixed}, {_field(low)})) end as changed from documents),
w0 as materialized (
  select doc_id, leaf, tree, tree as top, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, coalesce(changed, leaf) as have, '' as proof from leaves),
a0 as materialized (select tree, pos as i, count(*) over (partition by tree) as n, leaf as d from w0),
{''.join(level(k, 'a') for k in range(source_levels))}
t0 as materialized (select 0 as tree, tree as i, count(*) over () as n, d from a{source_levels}),
{''.join(level(k, 't') for k in range(top_levels))}
{''.join(climb(k, k, 'a') for k in range(source_levels))}
u as materialized (select * replace (top as pos) from w{source_levels}),
{climb(source_levels, 0, 't').replace(f'from w{source_levels} w', 'from u w')}
{''.join(climb(source_levels + k, k, 't') for k in range(1, top_levels))}
root as (select d from t{top_levels})
select doc_id, leaf, a{source_levels}.d as subroot, root.d as root, sha256(proof) as proof_sha256, have as folded_root, have = root.d as verified
from w{source_levels + top_levels} w join a{source_levels} on a{source_levels}.tree = w.top cross join root
"""


def _clusters(clusters: int = 40, rounds: int = 5) -> str:
    """Rounds are unrolled: assignments a0, a1, ... to centroids c0, c1, ..."""

    def assign(k: int) -> str:
        return f"""
a{k} as materialized (
  select r, any_value(id) as id, any_value(v) as v, min({{'d': list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': c}}) as best
  from kept cross join c{k} group by r),"""

    def move(k: int) -> str:
        return f"""
s{k} as (select c, j, sum(x) as s, count(*) as n from (select best.c as c, unnest(v) as x, generate_subscripts(v, 1) as j from a{k}) group by all),
c{k + 1} as materialized (
  select c{k}.c, coalesce(m.w, c{k}.w) as w from c{k} left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as w from s{k} group by c) m on m.c = c{k}.c),"""

    return f"""
with kept as materialized (
  select row_number() over () as r, vec_id as id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('2:' || id::varchar) nulls last, v) - 1 as c, v as w from kept qualify c < {clusters}),
{''.join(assign(k) + move(k) for k in range(rounds))}
{assign(rounds)}
f as (select id as vec_id, best.c::int as cluster, best.d as distance from a{rounds})
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(w, ',')) as centroid_sha256
from f join c{rounds} on c{rounds}.c = cluster
"""


def oracle_sql() -> dict[str, str]:
    """What SQL expresses as a whole. The other operators are held against brute force in tests."""
    return {"op10_near_dedup": NEAR_DEDUP, "op11_merkle_manifest": _merkle(), "op13_centroid_clusters": _clusters(), "secret_base_counts": SECRET_COUNTS}
