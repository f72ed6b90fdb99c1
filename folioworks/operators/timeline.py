"""The timeline of transfers and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators.records import between, dated
from folioworks.sources.archive import Archive

COLUMNS = ["event_type", "record_type", "record_id", "date", "title", "label", "score", "is_key_evidence", "source_order"]


def scored(t: DataFrame) -> DataFrame:
    c = {n: F.col(n) for n in ("seller", "buyer", "date", "price", "currency", "auction_house")}
    return t.withColumns(
        {
            "score": exprs.transaction_score(c["seller"], c["buyer"], c["date"], c["price"], c["auction_house"]),
            "label": exprs.transaction_label(c["seller"], c["buyer"], c["price"], c["currency"], c["auction_house"]),
        }
    )


def transfers(a: Archive, since: str | None = None, until: str | None = None, entity_id: int | None = None) -> DataFrame:
    """Dated transactions of live standalone documents; an entity filter is a semi join (no doubles by role)."""
    docs = a.standalone.select(F.col("id").alias("document_id"), "title", "is_key_evidence")
    if entity_id is not None:
        docs = docs.join(a.document_entities.where(F.col("entity_id") == entity_id), "document_id", "left_semi")
    t = a.transactions.where(F.col("date").isNotNull() & between(F.col("date"), since, until))
    out = scored(t.join(docs, "document_id"))
    return out.select(F.lit("transaction").alias("event_type"), F.lit("document").alias("record_type"), F.col("document_id").alias("record_id"), "date", "title", "label", "score", "is_key_evidence", F.lit(0).alias("source_order"))


def group_transfers(a: Archive, since: str | None = None, until: str | None = None, entity_id: int | None = None) -> DataFrame:
    """Dated transactions of live groups."""
    groups = a.live_groups.select(F.col("id").alias("group_id"), "title")
    if entity_id is not None:
        groups = groups.join(a.group_entities.where(F.col("entity_id") == entity_id), "group_id", "left_semi")
    t = a.group_transactions.where(F.col("date").isNotNull() & between(F.col("date"), since, until))
    out = scored(t.join(groups, "group_id"))
    return out.select(F.lit("transaction").alias("event_type"), F.lit("group").alias("record_type"), F.col("group_id").alias("record_id"), "date", "title", "label", "score", F.lit(0).alias("is_key_evidence"), F.lit(1).alias("source_order"))


def appearances(a: Archive, since: str | None = None, until: str | None = None) -> DataFrame:
    """Documents and groups by their depicted date; the filter takes the effective date."""
    docs = a.standalone.where(between(dated(), since, until)).select(F.lit("document").alias("event_type"), F.lit("document").alias("record_type"), F.col("id").alias("record_id"), F.col("date_depicted").alias("date"), "title", F.col("title").alias("label"), F.lit(None).cast("int").alias("score"), "is_key_evidence", F.lit(2).alias("source_order"))
    groups = a.live_groups.where(between(dated(), since, until)).select(F.lit("document").alias("event_type"), F.lit("group").alias("record_type"), F.col("id").alias("record_id"), F.col("date_depicted").alias("date"), "title", F.col("title").alias("label"), F.lit(None).cast("int").alias("score"), F.lit(0).alias("is_key_evidence"), F.lit(3).alias("source_order"))
    return docs.unionByName(groups)


def full(a: Archive, **filters) -> DataFrame:
    """All dated events."""
    return transfers(a, **filters).unionByName(appearances(a, **filters)).where(~exprs.blank(F.col("date"))).select(COLUMNS)


def ordered(a: Archive, **filters) -> DataFrame:
    """All dated events, of groups' transactions too, by date and then by kind: transfers of documents, of groups, documents, groups."""
    return full(a, **filters).unionByName(group_transfers(a, **filters).where(~exprs.blank(F.col("date"))).select(COLUMNS)).orderBy("date", "source_order", "record_id", "label")


def undated(a: Archive) -> DataFrame:
    """Records without a depicted date, dated by a range or not."""
    return appearances(a).where(exprs.blank(F.col("date")))


def by_year(events: DataFrame) -> DataFrame:
    """A23"""
    return events.groupBy(F.coalesce(F.nullif(F.substring("date", 1, 4), F.lit("")), F.lit("Unknown")).alias("year")).agg(F.count("*").alias("events"))


def entity_names(a: Archive) -> DataFrame:
    """Each live standalone document's entity names, in order."""
    named = a.document_entities.join(a.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("entity_names"))
    return a.standalone.select(F.col("id").alias("document_id"), "title").join(named, "document_id", "left")
