"""Duplicate declarations: classes of titles and characters that several blocks declare, and which block wins.

Two levels of grouped aggregates, so that no entity's rows are collected: first by (entity, what may differ), then by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of which a title has one value at a date; fields of a character that blocks are compared by.
SINGLETONS = ("holder", "liege", "government")
FIELDS = {"name": "display_name", "culture": "culture_id", "religion": "faith_id", "faith": "faith_id", "dynasty": "dynasty_id", "dynasty_house": "dynasty_house_id"}
COMPARED = ("display_name", "sex", "culture_id", "faith_id", "dynasty_id", "dynasty_house_id", "birth_date", "death_date")


def title_classes(blocks: DataFrame, operations: DataFrame, cutoff: int) -> DataFrame:
    """(title_id, classification, conflict_fields, winner). blocks: title_id, block_order, source_path, semantic_sha256;
    operations: title_id, effective_date, operation_key, scalar_value."""
    by_path = blocks.groupBy("title_id", "source_path").agg(F.count("*").alias("n"), F.min("semantic_sha256").alias("lo"), F.max("semantic_sha256").alias("hi"), F.max("block_order").alias("block"))
    each = by_path.groupBy("title_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("paths"), F.max(F.struct("source_path", "n", "block")).alias("last"))
    several = each.where("n > 1")
    dated = operations.where(F.col("operation_key").isin(*SINGLETONS) & F.col("scalar_value").isNotNull()).groupBy("title_id", "effective_date", "operation_key")
    differing = dated.agg(F.min("scalar_value").alias("lo"), F.max("scalar_value").alias("hi")).where("lo <> hi")
    before = F.col("effective_date") <= cutoff
    conflicts = differing.groupBy("title_id").agg(F.array_sort(F.collect_set(F.when(before, F.col("operation_key")))).alias("fields"), F.max(~before).alias("after"))
    held = F.size(F.coalesce("fields", F.array().cast("array<string>"))) > 0
    resolved = (F.col("paths") > 1) & (F.col("last.n") == 1)
    found = several.join(conflicts, "title_id", "left").withColumn(
        "classification",
        F.when(F.col("lo") == F.col("hi"), "semantic_identical").when(held & resolved, "resolved_by_source_order").when(held, "conflicting_at_baseline").when(F.col("after"), "conflicting_after_baseline").otherwise("additive_nonconflicting"),
    )
    kept = F.when(F.col("classification").isin("resolved_by_source_order", "conflicting_at_baseline"), F.col("fields")).otherwise(F.array().cast("array<string>"))
    out = found.select("title_id", "classification", kept.alias("conflict_fields"), F.when(F.col("classification") == "resolved_by_source_order", F.col("last.block")).alias("winner"))
    alone = each.where("n = 1").select("title_id", F.lit("unique").alias("classification"), F.array().cast("array<string>").alias("conflict_fields"), F.lit(None).cast("int").alias("winner"))
    return out.unionByName(alone.withColumn("winner", F.col("winner").cast(out.schema["winner"].dataType)))


def title_blocks(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks with their title's class and their own resolution: sole_declaration, winner, superseded or unresolved."""
    rows = blocks.join(classes, "title_id")
    resolution = F.when(F.col("classification") == "unique", "sole_declaration").when(F.col("winner") == F.col("block_order"), "winner").when(F.col("winner").isNotNull(), "superseded").otherwise("unresolved")
    return rows.withColumn("resolution", resolution)


def effective_operations(operations: DataFrame, classes: DataFrame) -> DataFrame:
    """Operations without those of blocks that another block of the title supersedes."""
    winners = classes.where("winner is not null").select("title_id", "winner")
    return operations.join(winners, "title_id", "left").where("winner is null or winner = block_order").drop("winner")


def character_order() -> Column:
    """Undated operations come first, then by date; ties by declaration."""
    return F.struct(F.col("effective_date").isNotNull(), "effective_date", "declaration_order")


def block_states(operations: DataFrame, cutoff: int) -> DataFrame:
    """What each block alone says of its character: (character_id, block_order) and the compared fields; sex is male where none is said."""
    order, value = character_order(), F.col("scalar_value")
    now = F.col("effective_date").isNull() | (F.col("effective_date") <= cutoff)
    said = value.isNotNull() & now

    def last(when: Column, what: Column) -> Column:
        return F.max_by(F.when(when, what), F.when(when, order))

    keys: dict[str, list[str]] = {}
    for key, field in FIELDS.items():
        keys.setdefault(field, []).append(key)
    picks = [last(said & F.col("operation_key").isin(*names), value).alias(field) for field, names in keys.items()]
    sex = F.coalesce(last(said & (F.col("operation_key") == "female"), F.when(value == "yes", "female").otherwise("male")), F.lit("male")).alias("sex")
    lives = [last((F.col("operation_key") == k) & F.col("effective_date").isNotNull(), F.col("effective_date")).cast("string").alias(f"{k}_date") for k in ("birth", "death")]
    return operations.groupBy("character_id", "block_order").agg(*picks, sex, *lives)


def character_classes(blocks: DataFrame, operations: DataFrame, cutoff: int, reviewed: DataFrame | None = None) -> DataFrame:
    """(character_id, classification, conflict_fields, winner, corrected, corrected_id) of characters with several blocks.

    blocks: character_id, block_order, semantic_sha256. reviewed: character_id, winner, corrected, corrected_id of adjudicated ones, as `adjudicated` gives them.
    """
    each = blocks.groupBy("character_id").agg(F.count("*").alias("n"), F.min("semantic_sha256").alias("lo"), F.max("semantic_sha256").alias("hi")).where("n > 1")
    # A block without operations says that its character is male, and nothing else.
    states = blocks.select("character_id", "block_order").join(each.select("character_id"), "character_id", "left_semi").join(block_states(operations, cutoff), ["character_id", "block_order"], "left").withColumn("sex", F.coalesce("sex", F.lit("male")))
    differ = [F.when(F.min(f) != F.max(f), F.lit(f)) for f in COMPARED]
    compared = states.groupBy("character_id").agg(F.array_sort(F.array_compact(F.array(*differ))).alias("fields"))
    none = F.array().cast("array<string>")
    found = each.join(compared, "character_id").withColumn("classification", F.when(F.col("lo") == F.col("hi"), "semantic_identical").when(F.size("fields") > 0, "conflicting_at_baseline").otherwise("additive_nonconflicting"))
    found = found.select("character_id", "classification", F.when(F.col("classification") == "conflicting_at_baseline", F.col("fields")).otherwise(none).alias("conflict_fields"))
    if reviewed is None:
        return found.select("*", F.lit(None).cast("int").alias("winner"), F.lit(None).cast("int").alias("corrected"), F.lit(None).cast("string").alias("corrected_id"))
    rows = found.join(reviewed, "character_id", "left")
    settled = F.col("winner").isNotNull()
    return rows.select("character_id", F.when(settled, "reviewed").otherwise(F.col("classification")).alias("classification"), F.when(settled, none).otherwise(F.col("conflict_fields")).alias("conflict_fields"), "winner", "corrected", "corrected_id")


EXPECTED = "character_id string, place int, source_path string, signature string, role string, corrected_id string"
# Adjudicated declarations. For each block in its place: path, what it says in order, and its role.
_LOPE = "name||Lope dynasty||681 religion||catholic culture||{} father||71410 mother||71411 birth|12080101|1208.1.1 death|12350101|1235.1.1"
ADJUDICATIONS = [
    ("71419", 1, "history/characters/basque.txt", _LOPE.format("basque"), "superseded", None),
    ("71419", 2, "history/characters/castilian.txt", _LOPE.format("castilian"), "winner", None),
    ("bobo0050", 1, "history/characters/bobo.txt", "name||Yama dynasty||bobodyn005 religion||west_african_pagan culture||bobo father||bobo0049 birth|11860101|yes death|12440101|yes", "winner", None),
    ("bobo0050", 2, "history/characters/bobo.txt", "name||Labidiedo dynasty||bobodyn006 religion||ashari culture||bobo father||bobo0059 birth|11930101|yes death|12540101|yes", "corrected", "bobo0060"),
]


def adjudicated(blocks: DataFrame, operations: DataFrame, expected: DataFrame) -> DataFrame:
    """(character_id, winner, corrected, corrected_id) where every block is as it was when it was reviewed, and a corrected id is free.

    expected: EXPECTED. Only the few characters in it are looked at.
    """
    ids = F.broadcast(expected.select("character_id").distinct())
    mine = blocks.join(ids, "character_id", "left_semi")
    said = F.concat_ws("|", "operation_key", F.coalesce(F.col("effective_date").cast("string"), F.lit("")), F.coalesce("scalar_value", F.lit("")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("declaration_order", said.alias("said")))), lambda x: x["said"]), " ")
    signed = operations.join(ids, "character_id", "left_semi").groupBy("character_id", "block_order").agg(listed.alias("signature"))
    rows = mine.join(signed, ["character_id", "block_order"], "left").select("character_id", "block_order", "source_path", "signature")
    taken = blocks.select(F.col("character_id").alias("corrected_id"), F.lit(True).alias("taken")).distinct()
    wanted = expected.join(taken, "corrected_id", "left")
    matched = rows.join(wanted, ["character_id", "source_path", "signature"]).groupBy("character_id").agg(
        F.count_distinct("place").alias("matched"), F.max(F.when(F.col("role") == "winner", F.col("block_order"))).alias("winner"), F.max(F.when(F.col("role") == "corrected", F.col("block_order"))).alias("corrected"),
        F.max("corrected_id").alias("corrected_id"), F.coalesce(F.max("taken"), F.lit(False)).alias("taken"),
    )
    whole = expected.groupBy("character_id").agg(F.count("*").alias("wanted")).join(mine.groupBy("character_id").agg(F.count("*").alias("n")), "character_id")
    ordered = matched.join(whole, "character_id").where("matched = wanted and n = wanted and not taken and (corrected is null or corrected > winner)")
    return ordered.select("character_id", "winner", "corrected", "corrected_id")


def character_blocks(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks with their class; blocks of reviewed characters are reviewed_winner, reviewed_corrected or reviewed_superseded."""
    rows = blocks.join(classes, "character_id", "left")
    own = F.when(F.col("winner") == F.col("block_order"), "reviewed_winner").when(F.col("corrected") == F.col("block_order"), "reviewed_corrected").when(F.col("winner").isNotNull(), "reviewed_superseded")
    return rows.withColumn("classification", F.coalesce(own, "classification", F.lit("unique")))


def settled_operations(operations: DataFrame, classes: DataFrame) -> DataFrame:
    """Operations of winning and corrected blocks, the latter under their corrected id, and of all characters that weren't reviewed."""
    settled = classes.where("winner is not null").select("character_id", "winner", "corrected", "corrected_id")
    rows = operations.join(settled, "character_id", "left").where("winner is null or block_order = winner or block_order = corrected")
    return rows.withColumn("character_id", F.when(F.col("block_order") == F.col("corrected"), F.col("corrected_id")).otherwise(F.col("character_id"))).drop("winner", "corrected", "corrected_id")
