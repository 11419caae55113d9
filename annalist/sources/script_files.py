"""Sources of script trees: declarations to any depth, landed titles, localisation, catalogs and the tree's own manifest.

One table function tokenises files; what a catalog means is said by DataFrame filters over its rows. Checks give rows of
problems, and `require_none` fails before anything is written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import script, text
from annalist.operators import replay

DECLARED = "path string, keys array<string>, ordinals array<int>, kind string, value string, line_start int, line_end int"
TITLE = "path string, title_id string, parent_title_id string, capital_title_id string, source_line int"
# The formats of title lines, capital lines and localisation lines, and the ranks.
TITLE_LINE = r"([ekdcb]_[A-Za-z0-9_-]+)\s*=\s*\{"
CAPITAL_LINE = r"capital\s*=\s*([ekdcb]_[A-Za-z0-9_-]+)"
LABEL_LINE = r"^\s*([^\s:#]+):(\d*)\s+\"(.*)\"\s*(?:#.*)?$"
RANKS = {"e": "empire", "k": "kingdom", "d": "duchy", "c": "county", "b": "barony"}


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below root: path relative to it, modificationTime, length, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/"))
    return found.withColumn("path", F.regexp_replace("path", rf"^.*?{base}/", ""))


def scan_order(path: str = "path") -> Column:
    """Paths compare by components."""
    return F.split(path, "/")


def declarations(source: DataFrame, depth: int) -> DataFrame:
    """Each assignment down to a depth: its keys and 0-based ordinals from the outermost one in. A file's order is that of ordinals."""

    def below(text: str, line: int, keys: tuple[str, ...], at: tuple[int, ...]) -> Iterator[tuple]:
        for n, a in enumerate(script.assignments(text, line)):
            block = a.kind == "block"
            yield [*keys, a.key], [*at, n], a.kind, a.raw if block else script.scalar(a.raw), a.line_start, a.line_end
            if block and len(keys) + 1 < depth:
                yield from below(a.raw[1:-1], a.line_start, (*keys, a.key), (*at, n))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = ((path, content) for batch in batches for path, content in zip(batch["path"], batch["content"]))
        rows = ((path, *row) for path, content in each for row in below(script.without_comments(script.decoded(bytes(content))), 1, (), ()))
        yield from script.framed(rows, DECLARED)

    return source.select("path", "content").mapInPandas(parse, DECLARED)


def title_declarations(source: DataFrame) -> DataFrame:
    """Every title line with the title it is indented under; a capital line belongs to the title line before it. Comments are cut at the first #."""

    def titles(path: str, content: bytes) -> list[list]:
        rows, open_titles = [], {}
        for number, whole in enumerate(script.decoded(content).splitlines(), 1):
            text = whole.partition("#")[0]
            body = text.strip()
            if m := re.match(TITLE_LINE, body):
                indent = len(text) - len(text.lstrip(" \t"))
                open_titles = {k: v for k, v in open_titles.items() if k < indent}
                rows.append([path, m[1], open_titles[max(open_titles)] if open_titles else None, None, number])
                open_titles[indent] = m[1]
            elif rows and (m := re.match(CAPITAL_LINE, body)):
                rows[-1][3] = m[1]
        return rows

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from script.framed((row for batch in batches for path, content in zip(batch["path"], batch["content"]) for row in titles(path, bytes(content))), TITLE)

    return source.select("path", "content").mapInPandas(parse, TITLE)


def numbered(rows: DataFrame, *within: str) -> DataFrame:
    """rows (path, ...) with source_order, 1 for the first in scan order. Files are counted first and their offsets summed over that small
    table, so that rows are numbered file by file and never in one task."""
    counts = rows.groupBy("path").agg(F.count("*").alias("n"))
    before = Window.orderBy(scan_order()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("path").orderBy(*within))
    return rows.join(offsets, "path").withColumn("source_order", F.col("_offset") + own).drop("_offset")


def landed_titles(source: DataFrame, last_wins: bool = False) -> DataFrame:
    """One row a title: its first declaration (or last), its rank and how many declarations it has."""
    found = title_declarations(source)
    order = F.struct(scan_order(), "source_line", "title_id")
    pick = F.max_by if last_wins else F.min_by
    rest = [c for c in found.columns if c != "title_id"]
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    one = found.groupBy("title_id").agg(pick(F.struct(*rest), order).alias("_row"), F.count("*").alias("declarations"))
    return one.select("title_id", F.element_at(rank, F.substring("title_id", 1, 1)).alias("title_rank"), *[F.col(f"_row.{c}").alias(c) for c in rest], "declarations")


def localisation(source: DataFrame, header: str = "l_english:") -> DataFrame:
    """Label lines of all files; a line that isn't one has a null key (a warning). A file without its header fails. All in the JVM."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    lines = source.select("path", F.split(text, r"\r\n|\r|\n").alias("lines"))
    told = F.filter("lines", lambda x: ~F.trim(x).rlike(r"^(#|\s*$)"))
    headed = F.when(F.regexp_replace(F.coalesce(F.get(told, F.lit(0)), F.lit("")), r"^\s+|\s+$", "") == header, F.col("lines")).otherwise(F.raise_error(F.concat(F.lit("missing header: "), "path")))
    each = lines.select("path", F.posexplode(headed).alias("at", "line")).where(~F.trim("line").rlike(r"^(#|\s*$)") & (F.trim("line") != header))
    part = [F.regexp_extract("line", LABEL_LINE, k) for k in (1, 2, 3)]
    ok = F.col("line").rlike(LABEL_LINE)
    plain = F.regexp_replace(part[2], r"\\([\"\\])", "$1")
    return each.select("path", (F.col("at") + 1).alias("source_line"), F.when(ok, part[0]).alias("localization_key"), F.when(part[1] != "", part[1].cast("int")).alias("value_version"), F.when(ok, plain).alias("display_value"))


def labels(source: DataFrame) -> DataFrame:
    """The label in force of each key: the last by scan order."""
    return replay.latest(localisation(source).where("localization_key is not null"), ["localization_key"], [scan_order().desc(), F.desc("source_line")])


def _key(n: int) -> Column:
    return F.get("keys", F.lit(n))


def _flat(rows: DataFrame, id_at: int, *more: Column) -> DataFrame:
    return rows.select(_key(id_at).alias("id"), *more, "path", "line_start", "line_end", "value")


def catalog(source: DataFrame) -> DataFrame:
    """Governments, dynasties: one row for each outermost block."""
    return _flat(declarations(source, 1).where("kind = 'block'"), 0)


def faiths(source: DataFrame) -> DataFrame:
    """Blocks under religion = { faiths = { ... } }."""
    return _flat(declarations(source, 3).where((F.size("keys") == 3) & (_key(1) == "faiths") & (F.col("kind") == "block")), 2, _key(0).alias("religion_id"))


def field(source: DataFrame, name: str) -> DataFrame:
    """id, value, n: each outermost block's scalar of that name (a house's dynasty, a culture's language) and how often it is given."""
    rows = declarations(source, 2)
    given = rows.where((F.size("keys") == 2) & (_key(1) == name)).groupBy("path", F.element_at("ordinals", 1).alias("at")).agg(F.max(F.when(F.col("kind") == "scalar", F.col("value"))).alias("_value"), F.count("*").alias("n"))
    blocks = rows.where((F.size("keys") == 1) & (F.col("kind") == "block")).select(_key(0).alias("id"), "path", F.element_at("ordinals", 1).alias("at"), "line_start")
    return blocks.join(given, ["path", "at"], "left").select("id", F.col("_value").alias("value"), F.coalesce("n", F.lit(0)).alias("n"), "path", "line_start")


def not_one_scalar(source: DataFrame, name: str) -> DataFrame:
    """Problems: outermost blocks that don't give the field just once, as a scalar (a house's dynasty)."""
    rows = field(source, name).where("n <> 1 or value is null")
    return problems(f"must declare one scalar {name}", rows, "id")


def languages(pillars: DataFrame) -> DataFrame:
    return field(pillars, "type").where("value = 'language'").select("id", "path", "line_start")


def nicknames(source: DataFrame) -> DataFrame:
    """id, is_bad, is_prefix: yes or no, no by default."""
    rows = declarations(source, 2).groupBy("path", F.element_at("ordinals", 1).alias("at"))
    said = [F.coalesce(F.max(F.when((F.size("keys") == 2) & (_key(1) == k), F.col("value") == "yes")), F.lit(False)).alias(k) for k in ("is_bad", "is_prefix")]
    return rows.agg(F.min(_key(0)).alias("id"), *said, F.max(F.col("keys")[0].isNotNull() & (F.size("keys") == 1) & (F.col("kind") == "block")).alias("block")).where("block").drop("at", "block")


def nickname_problems(source: DataFrame) -> DataFrame:
    """What isn't allowed in a nickname file: outermost scalars, other fields, flags that are given twice, blocks, or values other than yes and no."""
    rows = declarations(source, 2)
    inner = F.size("keys") == 2
    wrong = F.when((F.size("keys") == 1) & (F.col("kind") != "block"), "nickname isn't a block").when(inner & ~_key(1).isin("is_bad", "is_prefix"), "unknown nickname field").when(inner & ((F.col("kind") != "scalar") | ~F.col("value").isin("yes", "no")), "nickname flag isn't yes or no")
    named = rows.select(wrong.alias("rule"), F.array_join("keys", "/").alias("subject")).where("rule is not null")
    twice = rows.where(inner).groupBy("path", F.element_at("ordinals", 1).alias("at"), "keys").count().where("count > 1")
    return named.unionByName(twice.select(F.lit("nickname flag is given twice").alias("rule"), F.array_join("keys", "/").alias("subject")))


def obligations(source: DataFrame) -> DataFrame:
    """Levels of each contract type's obligation_levels by their order, and which is the default."""
    rows = declarations(source, 4).where((F.size("keys") >= 3) & (_key(1) == "obligation_levels"))
    level = rows.groupBy("path", F.slice("ordinals", 1, 3).alias("at")).agg(
        F.min(_key(0)).alias("type_id"), F.min(_key(2)).alias("level_id"), F.coalesce(F.max(F.when(_key(3) == "default", F.col("value") == "yes")), F.lit(False)).alias("is_default"), F.min("line_start").alias("line_start")
    )
    return level.withColumn("level_index", F.element_at("at", 3)).drop("at")


def contract_problems(source: DataFrame, files: int, types: int, levels: int) -> DataFrame:
    """Contract types without exactly one block of levels, levels whose default isn't yes or no, and a corpus of another shape than reviewed."""
    rows = declarations(source, 4)
    one = rows.groupBy("path", F.element_at("ordinals", 1).alias("at")).agg(F.min(_key(0)).alias("id"), F.count_if((F.size("keys") == 2) & (_key(1) == "obligation_levels") & (F.col("kind") == "block")).alias("n"))
    out = problems("contract type needs one block of levels", one.where("n <> 1"), "id")
    wrong = rows.where((F.size("keys") == 4) & (_key(1) == "obligation_levels") & (_key(3) == "default") & ~F.col("value").isin("yes", "no"))
    out = out.unionByName(problems("default isn't yes or no", wrong.select(F.array_join("keys", "/").alias("id")), "id"))
    shape = source.agg(F.count("*").alias("f")).crossJoin(one.agg(F.count("*").alias("t"))).crossJoin(obligations(source).agg(F.count("*").alias("l")))  # one row each
    return out.unionByName(problems("corpus shape changed", shape.where((F.col("f") != files) | (F.col("t") != types) | (F.col("l") != levels)).select(F.concat_ws("/", "f", "t", "l").alias("id")), "id"))


def culture_languages(cultures: DataFrame, pillars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, language_id) of cultures, and problems: a culture needs exactly one language, and that has to be a pillar of type language."""
    said = field(cultures, "language")
    known = languages(pillars)
    out = problems("culture needs one language", said.where("n <> 1"), "id").unionByName(unresolved(said.where("n = 1"), "value", known))
    return said.where("n = 1").join(known.select(F.col("id").alias("value")), "value").select("id", F.col("value").alias("language_id")), out


def tributary_groups(source: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract groups that are referred to, and problems: those that are lacking or aren't marked as tributary."""
    marked = field(source, "is_tributary")
    held, lacking = required(marked, wanted)
    return held, lacking.unionByName(problems("group isn't tributary", held.where("not value <=> 'yes'"), "id"))


def entries(source: DataFrame) -> DataFrame:
    """Files and all folders above them: path (composed), kind, length, content_sha256, folded."""
    kept = source.select(text.nfc("path").alias("path"), F.lit("file").alias("kind"), "length", F.sha2("content", 256).alias("content_sha256"))
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    folders = kept.where(F.size(parts) > 1).select(above.alias("path")).distinct().select("path", F.lit("directory").alias("kind"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("content_sha256"))
    return kept.unionByName(folders).withColumn("folded", text.casefolded("path"))


def entry_problems(found: DataFrame) -> DataFrame:
    """Paths that are equal once composed, or but for case."""
    same = found.groupBy("path").count().where("count > 1")
    folded = found.groupBy("folded").agg(F.count_distinct("path").alias("n")).where("n > 1")
    return problems("duplicate normalized path", same, "path").unionByName(problems("case-fold path collision", folded, "folded"))


def clipboard(rows: DataFrame, column: str = "text") -> DataFrame:
    """Pasted texts with their number of lines that aren't blank, to be reviewed."""
    lines = F.filter(F.split(column, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    return rows.withColumn("line_count", F.size(lines)).withColumn("review_status", F.lit("needs_review"))


def problems(rule: str, rows: DataFrame, subject: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    return problems(f"duplicate {key}", rows.groupBy(key).count().where("count > 1"), key)


def unresolved(rows: DataFrame, column: str, known: DataFrame, key: str = "id") -> DataFrame:
    """Values that the other catalog lacks; null is unresolved too."""
    return problems(f"unresolved {column}", rows.join(known.select(F.col(key).alias("_known")), F.col(column) == F.col("_known"), "left_anti"), column)


def required(rows: DataFrame, wanted: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of a catalog that are referred to, and problems for those it lacks."""
    ids = wanted.select(key).distinct()
    return rows.join(ids, key, "left_semi"), problems(f"missing {key}", ids.join(rows, key, "left_anti"), key)


def require_none(*found: DataFrame) -> None:
    first = reduce(DataFrame.unionByName, found).limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.rule}: {r.subject}" for r in first))


def manifest(source: DataFrame) -> DataFrame:
    """path, length, content_sha256 of each file."""
    return source.select("path", "length", F.sha2("content", 256).alias("content_sha256"))


def tree_digest(rows: DataFrame) -> DataFrame:
    """One digest of a manifest, whatever its order: of 4,096 buckets of paths first, then of their digests."""
    line = F.to_json(F.struct("path", "length", "content_sha256"))
    part = rows.groupBy(F.pmod(F.xxhash64("path"), F.lit(4096)).alias("b")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("d"), F.count("*").alias("n"))
    return part.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "b", "d")))), 256).alias("tree_sha256"), F.sum("n").alias("n_files"))


def case_collisions(rows: DataFrame) -> DataFrame:
    folded = rows.groupBy(F.lower("path").alias("folded")).agg(F.count_distinct("path").alias("n"))
    return problems("case collision", folded.where("n > 1"), "folded")


def build_evidence(text: Column, launcher: Column) -> list[Column]:
    """Build number and branch of a store manifest, and the launcher's version."""
    return [F.regexp_extract(text, r'(?m)^\s*"buildid"\s+"([^"]*)"', 1).alias("build_id"), F.regexp_extract(text, r'(?m)^\s*"BetaKey"\s+"([^"]*)"', 1).alias("branch"), F.get_json_object(launcher, "$.rawVersion").alias("raw_version")]
