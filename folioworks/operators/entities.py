"""Entity roll-ups, co-occurrence, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.sources import shared
from folioworks.sources.archive import Archive

#: Links of a task that drops repeats.
LINKS = 1_000_000


def record_links(a: Archive) -> DataFrame:
    """Distinct (entity_id, record_id, kind) over standalone documents, child pages' groups and groups."""
    docs = a.documents.where("is_trashed = 0").select(F.col("id").alias("document_id"), "group_id")
    groups = a.live_groups.select(F.col("id").alias("group_id"))
    linked = a.document_entities.join(docs, "document_id")
    alone = linked.where("group_id is null").select("entity_id", F.col("document_id").alias("record_id"), F.lit("d").alias("kind"))
    child = linked.join(groups, "group_id", "left_semi").select("entity_id", F.col("group_id").alias("record_id"), F.lit("g").alias("kind"))
    own = a.group_entities.join(groups, "group_id", "left_semi").select("entity_id", F.col("group_id").alias("record_id"), F.lit("g").alias("kind"))
    return alone.union(child).union(own).distinct()


def record_counts(a: Archive) -> DataFrame:
    """Every entity with its number of records."""
    counts = record_links(a).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("doc_count"))
    return a.entities.join(counts, "id", "left").select("id", "name", "type", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def search(a: Archive, text: str, aliases: DataFrame | None = None) -> DataFrame:
    """Entities whose name or an alias contains the text, as it is."""
    needle = F.lit(text.lower())
    named = a.entities.where(F.contains("normalized_name", needle)).select("id")
    if aliases is not None:
        named = named.union(aliases.where(F.contains("normalized_name", needle)).select(F.col("entity_id").alias("id")))
    return a.entities.join(named.distinct(), "id", "left_semi")


def cooccurring(a: Archive, entity_id: int) -> DataFrame:
    """Entities that share records with one: rows of documents by role, and groups once."""
    links = a.document_entities.join(a.standalone.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    mine = links.where(F.col("entity_id") == entity_id).select("document_id")
    docs = links.join(mine, "document_id").where(F.col("entity_id") != entity_id).select("entity_id")
    of_groups = record_links(a).where("kind = 'g'").select("entity_id", "record_id")
    groups = of_groups.where(F.col("entity_id") == entity_id).select("record_id")
    also = of_groups.join(groups, "record_id", "left_semi").where(F.col("entity_id") != entity_id).select("entity_id")
    return docs.unionByName(also).groupBy("entity_id").agg(F.count("*").alias("shared"))


def cooccurring_simple(a: Archive, entity_id: int) -> DataFrame:
    """The tool's variant, all documents, no groups."""
    mine = a.document_entities.where(F.col("entity_id") == entity_id).select("document_id")
    return a.document_entities.join(mine, "document_id").where(F.col("entity_id") != entity_id).groupBy("entity_id").agg(F.count("*").alias("shared"))


def orphans(a: Archive) -> DataFrame:
    """Entities that nothing links to."""
    used = a.document_entities.select("entity_id").union(a.group_entities.select("entity_id")).distinct()
    return a.entities.join(used, F.col("id") == F.col("entity_id"), "left_anti")


def resolved(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """M1: (name, type) to an id: an entity of that name, else an alias of an entity of the type, else a new id.

    New ids follow the largest one in order of name; they are numbered within ranges of
    names, so no task sorts all new names. Rows of new names are computed when this is called.
    """
    wanted = names.select(exprs.normalized_name(F.col("name")).alias("normalized_name"), "type").where("normalized_name <> ''").distinct()
    known = entities.select("normalized_name", "type", F.col("id").alias("by_name"))
    typed = aliases.join(entities.select(F.col("id").alias("entity_id"), "type"), "entity_id").groupBy("normalized_name", "type").agg(F.min("entity_id").alias("by_alias"))
    found = wanted.join(known, ["normalized_name", "type"], "left").join(typed, ["normalized_name", "type"], "left").withColumn("id", F.coalesce("by_name", "by_alias"))
    # ranges of names, even whatever the names begin with, are fixed in a staged table before they are counted
    new = found.where("id is null").select("normalized_name", "type").repartitionByRange("normalized_name", "type").withColumn("slice", F.spark_partition_id())
    new = shared.staged(new, "new-names")
    sizes = new.groupBy("slice").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("rn", F.row_number().over(Window.partitionBy("slice").orderBy("normalized_name", "type"))).join(before, "slice").crossJoin(top)  # top: one row
    fresh = numbered.select("normalized_name", "type", (F.col("top") + F.col("before") + F.col("rn")).alias("id"), F.lit("new").alias("how"))
    old = found.where("id is not null").select("normalized_name", "type", "id", F.when(F.col("by_name").isNotNull(), "name").otherwise("alias").alias("how"))
    return old.unionByName(fresh)


def merged(links: DataFrame, keep: int, discard: int) -> DataFrame:
    """One entity's links move to another; links that it has already are dropped, NULL roles never collide.

    Links are staged and dealt over tasks of about LINKS rows, so a task's memory doesn't grow with the table.
    """
    moved = shared.staged(links.withColumn("entity_id", F.when(F.col("entity_id") == discard, keep).otherwise(F.col("entity_id"))), "moved")
    key = ["document_id", "entity_id", "role"]
    dealt = moved.where("role is not null").repartition(max(1, -(-moved.count() // LINKS)), *key)
    return dealt.dropDuplicates(key).unionByName(moved.where("role is null"))


def new_aliases(offered: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """M2: offered (entity_id, name) that are neither blank, the own name nor there already."""
    named = offered.withColumn("normalized_name", exprs.normalized_name(F.col("name"))).where("normalized_name <> ''").dropDuplicates(["entity_id", "normalized_name"])
    own = entities.select(F.col("id").alias("entity_id"), "normalized_name")
    return named.join(own, ["entity_id", "normalized_name"], "left_anti").join(aliases, ["entity_id", "normalized_name"], "left_anti")


def repointed(aliases: DataFrame, entities: DataFrame, keep: int, discard: int) -> DataFrame:
    """Aliases (entity_id, normalized_name) after a merge: the discarded entity's move, its name becomes one, and none repeats or is the survivor's own name."""
    moved = aliases.withColumn("entity_id", F.when(F.col("entity_id") == discard, keep).otherwise(F.col("entity_id")).cast("long"))
    named = entities.where(F.col("id") == discard).select(F.lit(keep).cast("long").alias("entity_id"), "normalized_name")
    own = entities.select(F.col("id").alias("entity_id"), "normalized_name")
    return moved.select("entity_id", "normalized_name").union(named).distinct().join(own, ["entity_id", "normalized_name"], "left_anti")


def merged_groups(links: DataFrame, keep: int, discard: int) -> DataFrame:
    """`merged` for groups."""
    return merged(links.withColumnRenamed("group_id", "document_id"), keep, discard).withColumnRenamed("document_id", "group_id")


def renamed(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """New names and types by id (changes: id, new_name, new_type, NULL for no change), names normalised again.

    Changes with a type hold for the entity of that id and type alone: a large archive's kinds of entities share ids.
    """
    both = entities.join(changes, ["id", "type"] if "type" in changes.columns else "id", "left")
    name = F.coalesce("new_name", "name")
    return both.select("id", name.alias("name"), F.coalesce("new_type", "type").alias("type"), exprs.normalized_name(name).alias("normalized_name"))


def clashes(entities: DataFrame) -> DataFrame:
    """Names that two entities of a type have; a rename that makes any is refused."""
    return entities.groupBy("normalized_name", "type").agg(F.count("*").alias("entities")).where("entities > 1")


def without(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Tables without the rows of deleted entities; each is given with the column that names its entity."""
    return {name: df.join(ids.select(F.col("id").alias(column)), column, "left_anti") for name, (df, column) in tables.items()}
