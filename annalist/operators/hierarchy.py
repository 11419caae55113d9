"""Title hierarchies: ancestors of all titles, validation, flattening, capitals, and the checked chain above a starting title.

A title's rank is in its id, and on a sound way up ranks only rise. So after k hops an ancestor is of the k-th rank above the lowest at least, and the table
that hop k joins has the titles of those ranks alone: it shrinks from rank to rank, only the first join is a large one, and AQE broadcasts the right sides of
the others once it sees their size. Edges that don't rise are marked and not followed: their titles are nodes of a smaller table, each pointing to the next such title
above, and pointer doubling resolves it in as many rounds as the logarithm of the longest way; what lies below takes over their chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import pointers
from annalist.session import dropped, tidied, written

RANKS = "bcdke"
HOPS = 5
#: Rank by letter, and the rank that a rank's parent must have.
RANK_OF = {"e": "empire", "k": "kingdom", "d": "duchy", "c": "county", "b": "barony"}
LADDER = ("barony", "county", "duchy", "kingdom", "empire")
_PATH = "array<string>"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def rank_of(title: Column) -> Column:
    return F.try_element_at(_map(RANK_OF), F.substring(title, 1, 1))


def declared(titles: DataFrame, last: bool = False) -> DataFrame:
    """One row a title: (title_id, parent_title_id, n, source_order) by its first declaration (or last), how many there are, and the place of the first. titles: title_id, parent_title_id, source_order."""
    # The least (or greatest) of a struct is that of its first field. Texts in an aggregate are sorted for; dealt by title first, rows are sorted
    # once instead of before and after the shuffle. A title has few declarations, so nothing is gained by combining them before.
    pick = F.max if last else F.min
    one = titles.select("title_id", "parent_title_id", "source_order").repartition("title_id").groupBy("title_id").agg(pick(F.struct("source_order", F.coalesce("parent_title_id", F.lit("")).alias("p"))).alias("_p"), F.count("*").alias("n"), F.min("source_order").alias("source_order"))
    return one.select("title_id", F.nullif("_p.p", F.lit("")).alias("parent_title_id"), "n", "source_order")


def _level(column: str) -> Column:
    """1 for a barony to 5 for an empire, 0 for what is no title."""
    return F.expr(f"locate(substring({column}, 1, 1), '{RANKS}')")


def chains(nodes: DataFrame, edges: DataFrame | None = None, letters: bool = False) -> DataFrame:
    """(title_id, path, missing, cyclic) of every title: its ancestors from the parent up as far as they exist, the first that doesn't, and whether
    the way up runs in a circle (the path is then of no use). nodes: title_id (unique), parent_title_id; its other columns are kept.
    edges: what nodes were chosen from, if it is cheaper to look for edges that don't rise there. letters: the path is a text of the ancestors' rank letters alone,
    which is a small part of what their ids take in every round of the pointers."""
    spark = nodes.sparkSession
    extra = [c for c in nodes.columns if c not in ("title_id", "parent_title_id")]
    turns = F.col("parent_title_id").isNotNull() & (_level("parent_title_id") <= _level("title_id"))
    with tidied(spark):
        sound = (nodes if edges is None else edges).where(turns).isEmpty()
    if not sound:
        # Five joins, the odd titles and the result read these: written once, none of them shuffles all declarations again.
        nodes = written(spark, nodes, "titles")
    own = nodes.select("title_id", "parent_title_id")
    marked = own.select("title_id", F.when(~F.coalesce(turns, F.lit(False)), F.col("parent_title_id")).alias("up"), F.coalesce(turns, F.lit(False)).alias("turn"))
    rows = nodes.select("title_id", *extra, F.when(~F.coalesce(turns, F.lit(False)), F.col("parent_title_id")).alias("p1"), F.coalesce(turns, F.lit(False)).alias("t0"))
    for k in range(1, HOPS):
        step = marked.where(_level("title_id") > k).select(F.col("title_id").alias(f"p{k}"), F.col("up").alias(f"p{k + 1}"), F.col("turn").alias(f"t{k}"))
        rows = rows.join(step, f"p{k}", "left")
    there = [F.col(f"t{k}").isNotNull() for k in range(1, HOPS)]
    path = F.array_compact(F.array(*[F.when(there[k - 1], F.col(f"p{k}")) for k in range(1, HOPS)]))
    if letters:
        path = F.array_join(F.transform(path, lambda x: F.substring(x, 1, 1)), "")
    first, none = (F.substring("parent_title_id", 1, 1), F.lit("")) if letters else (F.array("parent_title_id"), F.array().cast(_PATH))
    missing = F.coalesce(*[F.when(~there[k - 1], F.col(f"p{k}")) for k in range(1, HOPS)])
    turn = F.coalesce(F.when(F.col("t0"), F.col("title_id")), *[F.when(F.col(f"t{k}"), F.col(f"p{k}")) for k in range(1, HOPS)])
    found = rows.select("title_id", *extra, path.alias("path"), missing.alias("missing"), turn.alias("_turn"))
    if sound:
        return found.select("title_id", *extra, "path", "missing", F.lit(False).alias("cyclic"))
    found = written(spark, found, "rising-titles")
    # An odd title's way: its parent, the rising titles above, and so on from the next odd one.
    ways = found.select(F.col("title_id").alias("parent_title_id"), "path", "missing", "_turn")
    odd = own.where(turns).join(ways, "parent_title_id", "left")
    there = F.col("path").isNotNull()
    steps = odd.select(F.col("title_id").alias("node"), F.col("_turn").alias("next"), F.when(there, F.concat(first, "path")).alias("along"), F.when(there, F.col("missing")).otherwise(F.col("parent_title_id")).alias("missing"))
    steps = written(spark, steps, "odd-titles")
    dropped(nodes)
    ends = pointers.resolved(steps.select("node", "next", "along")).join(steps.select(F.col("node").alias("end"), F.col("missing").alias("_missing")), "end")
    above = ends.select(F.col("node").alias("_turn"), F.col("along").alias("_path"), "_missing", F.col("cyclic").alias("_cyclic"))
    both = found.join(above, "_turn", "left")
    return both.select("title_id", *extra, F.concat("path", F.coalesce("_path", none)).alias("path"), F.coalesce("missing", "_missing").alias("missing"), F.coalesce("_cyclic", F.lit(False)).alias("cyclic"))


def validated(titles: DataFrame) -> DataFrame:
    """(title_id, selectable, warning). In order: duplicate, cycle, missing parent, rank chain. titles: title_id, parent_title_id, source_order."""
    nodes = declared(titles)
    ranks = F.concat(F.substring("title_id", 1, 1), "path")
    wanted = F.expr(f"substring('{RANKS}', instr('{RANKS}', substring(title_id, 1, 1)))")
    warning = F.when(F.col("n") > 1, "duplicate title declarations").when(F.col("cyclic"), "cyclic parent hierarchy").when(F.col("missing").isNotNull(), F.concat(F.lit("missing parent title: "), "missing")).when(ranks != wanted, F.concat(F.lit("non-canonical rank chain: "), ranks))
    return chains(nodes, titles, letters=True).select("title_id", warning.isNull().alias("selectable"), warning.alias("warning"))


def first_child(titles: DataFrame, order: str) -> DataFrame:
    """The first child of each parent by an order."""
    return titles.groupBy(F.col("parent_title_id").alias("title_id")).agg(F.min_by("title_id", order).alias("capital_id"))


def static_capitals(titles: DataFrame) -> DataFrame:
    """(title_id, capital_id, capital_status): as declared, else a county's first barony. titles: title_id, parent_title_id, capital_title_id, source_order, one row each."""
    first = first_child(titles.where("title_id like 'b%' and parent_title_id like 'c%'"), "source_order").withColumnRenamed("capital_id", "first")
    rows = titles.join(first, "title_id", "left")
    said, county, barony = F.col("capital_title_id").isNotNull(), F.col("title_id").startswith("c"), F.col("title_id").startswith("b")
    status = F.when(said, "declared_static").when(county & F.col("first").isNotNull(), "derived_first_barony").when(barony, "not_applicable").otherwise("no_declaration")
    return rows.select("title_id", F.coalesce("capital_title_id", F.when(county, F.col("first"))).alias("capital_id"), status.alias("capital_status"))


def flattened(titles: DataFrame) -> DataFrame:
    """Baronies with their four ancestors and whether they are their county's first; those without an installed county and duchy are dropped.

    Of several declarations of a title the last counts. titles: title_id, parent_title_id, source_order.
    """
    nodes = declared(titles, last=True).drop("n")
    leaves = chains(nodes, titles).where("title_id like 'b%' and size(path) >= 2")
    first = F.min(F.struct("source_order", "title_id")).over(Window.partitionBy(F.get("path", F.lit(0))))
    rows = leaves.select("title_id", "path", (first["title_id"] == F.col("title_id")).alias("is_county_capital"))
    return rows.select(F.col("title_id").alias("barony"), *[F.get("path", F.lit(k)).alias(name) for k, name in enumerate(("county", "duchy", "kingdom", "empire"))], "is_county_capital")


def resolved(starts: DataFrame, titles: DataFrame) -> DataFrame:
    """The chain above each starting title (title_id): empire, kingdom, duchy, county, barony and `error`, null where it is whole. titles: title_id, title_rank, parent_title_id, selectable."""
    open_titles = titles.where("selectable").select("title_id", "parent_title_id", "title_rank")
    rows = starts.select("title_id").join(chains(open_titles), "title_id", "left")
    # A title's rank is read off its letter; the ladder from the starting rank up is what the path must show.
    below = F.array_position(F.array(*map(F.lit, LADDER)), F.col("title_rank")).cast("int")
    whole = F.concat(F.array("title_id"), "path")
    shown = F.transform(whole, rank_of)
    wanted = F.slice(F.array(*map(F.lit, LADDER)), F.greatest(below, F.lit(1)), F.lit(len(LADDER)))
    bad = F.array_position(F.transform(F.arrays_zip(shown.alias("a"), wanted.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False))), False).cast("int")
    at = F.when(bad > 1, F.get(whole, bad - 2))
    size, need = F.size(whole), F.size(wanted)
    error = (
        F.when(F.col("title_rank").isNull(), F.concat(F.lit("Unknown or non-selectable title: "), "title_id"))
        .when(~F.col("title_rank").isin(*LADDER), F.concat(F.lit("Unsupported title rank: "), "title_rank"))
        .when(F.col("cyclic"), F.concat(F.lit("Invalid parent for title: "), "title_id"))
        .when((bad > 0) & (bad <= F.least(size, need)), F.concat(F.lit("Invalid parent for title: "), at))
        .when((size == need) & F.col("missing").isNotNull(), F.lit("Empire title cannot have a parent title"))
        .when(size > need, F.lit("Empire title cannot have a parent title"))
        .when(F.col("missing").isNotNull(), F.concat(F.lit("Invalid parent for title: "), F.element_at(whole, -1)))
        .when(size < need, F.concat(F.lit("Incomplete title hierarchy above: "), F.element_at(whole, -1)))
    )
    # A chain with an error may show a rank twice, so the map is of sound ones.
    ranked = F.when(error.isNull(), F.map_from_arrays(shown, whole))
    return rows.select("title_id", error.alias("error"), *[F.try_element_at(ranked, F.lit(r)).alias(r) for r in reversed(LADDER)])


def ancestors(leaves: DataFrame, titles: DataFrame) -> DataFrame:
    """(leaf, title_id, depth): each leaf (title_id) and all titles above it, as far as they exist. titles: title_id, parent_title_id, one row each."""
    rows = chains(titles).join(leaves.select("title_id"), "title_id", "left_semi")
    return rows.select(F.col("title_id").alias("leaf"), F.posexplode(F.concat(F.array("title_id"), "path")).alias("depth", "title_id")).select("leaf", "title_id", "depth")


def followed(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(localization_key, display_name) of keys whose label, or the label that `$other$` leads to in the end, exists. labels: localization_key, display_value, one row each."""
    alias = F.nullif(F.regexp_extract("display_value", r"^\$([^$]+)\$$", 1), F.lit(""))
    ends = pointers.resolved(labels.select(F.col("localization_key").alias("node"), alias.alias("next"), F.array().cast(_PATH).alias("along")))
    found = ends.where(~F.col("cyclic") & F.col("loose").isNull()).select(F.col("node").alias("localization_key"), "end")
    texts = labels.select(F.col("localization_key").alias("end"), F.col("display_value").alias("display_name"))
    return keys.select("localization_key").distinct().join(found, "localization_key").join(texts, "end").select("localization_key", "display_name")
