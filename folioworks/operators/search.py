"""One ranking over the indexes of documents and of groups, and retrieval with its fallbacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.operators import pages, postings, text
from folioworks.operators.records import from_archive
from folioworks.operators.segments import Index

#: Score of a record that is found by the name of an entity alone.
NAMED = 0.5


@dataclass
class Corpus:
    """What a search reads. docs: id, title, description, annotation, source_archive, is_trashed, group_id, date_depicted and the
    indexed columns; groups: the same but group_id. Links: (document_id or group_id, entity_id or tag)."""

    docs: DataFrame
    groups: DataFrame
    entities: DataFrame
    document_entities: DataFrame
    group_entities: DataFrame
    document_tags: DataFrame
    group_tags: DataFrame
    doc_index: Index
    group_index: Index


@dataclass(frozen=True)
class Filters:
    tags: tuple[str, ...] = ()
    entity_id: object = None
    archive: str | None = None

    def __bool__(self) -> bool:
        return bool(self.tags or self.entity_id is not None or self.archive)

    def of(self, records: DataFrame, key: str, tags: DataFrame, entities: DataFrame) -> DataFrame:
        """Live records that pass; tags and entities by semi joins, so none doubles."""
        out = records.where((F.col("is_trashed") == 0) & from_archive(self.archive or None))
        if self.tags:
            out = out.join(tags.where(F.col("tag").isin(*self.tags)).select(F.col(key).alias("id")), "id", "left_semi")
        if self.entity_id is not None:
            out = out.join(entities.where(F.col("entity_id") == F.lit(self.entity_id)).select(F.col(key).alias("id")), "id", "left_semi")
        return out


def _shown(records: DataFrame, kind: str) -> DataFrame:
    return records.select(F.lit(kind).alias("record_type"), "id", "title", "date_depicted", "description")


def keyword(c: Corpus, typed: str, filters: Filters = Filters()) -> DataFrame:
    """All that a typed query finds: (record_type, id, title, score, snippet, source); source 1 to 4 are documents and groups
    by their texts, then by the names of entities.

    Each text hit is scored by its own index, over all of that index; filters come after, and only to documents
    found by text. A record stands once, as first found. An empty query browses the filters' records, or finds nothing.
    """
    kind, words = text.escaped(typed)
    if kind == "empty":
        return browsed(c, filters)
    docs = filters.of(c.docs.where("group_id is null"), "document_id", c.document_tags, c.document_entities)
    live_docs, live_groups = c.docs.where("is_trashed = 0 and group_id is null"), c.groups.where("is_trashed = 0")
    named = c.entities.where(F.contains(F.lower("name"), F.lit(typed.lower()))).select("entity_id")
    mark = postings.snippet(F.col("description"), words)
    sources = [
        _shown(docs, "document").join(c.doc_index.scored(typed).drop("tf"), "id").withColumn("snippet", mark),
        _shown(live_groups, "group").join(c.group_index.scored(typed).drop("tf"), "id").withColumn("snippet", mark),
    ]
    for records, record, links, key in ((live_docs, "document", c.document_entities, "document_id"), (live_groups, "group", c.group_entities, "group_id")):
        linked = links.join(named, "entity_id", "left_semi").select(F.col(key).alias("id"))
        sources.append(_shown(records.join(linked, "id", "left_semi"), record).withColumns({"score": F.lit(NAMED), "snippet": F.lit("")}))
    columns = ["record_type", "id", "title", "score", "snippet", "source"]
    parts = [s.withColumn("source", F.lit(n)).select(*columns) for n, s in enumerate(sources, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a column of its own for each: where snippets aren't asked for, no text is read for them
    return out.groupBy("record_type", "id").agg(*(F.min_by(c, "source").alias(c) for c in ("title", "score", "snippet")), F.min("source").alias("source"))


def browsed(c: Corpus, filters: Filters) -> DataFrame:
    """The filters' documents, pages of groups too, then their groups; nothing without a filter. As `keyword`, score 0."""
    docs = _shown(filters.of(c.docs, "document_id", c.document_tags, c.document_entities), "document").withColumn("source", F.lit(1))
    groups = _shown(filters.of(c.groups, "group_id", c.group_tags, c.group_entities), "group").withColumn("source", F.lit(2))
    out = docs.unionByName(groups).where(F.lit(bool(filters)))
    return out.select("record_type", "id", "title", F.lit(0.0).alias("score"), F.lit("").alias("snippet"), "source", "date_depicted")


def page(found: DataFrame, number: int = 1, per_page: int = 50) -> DataFrame:
    """The best first, of equal ones in order of their sources and ids; what was browsed, the latest first."""
    date = [F.desc_nulls_last("date_depicted"), F.desc("id")] if "date_depicted" in found.columns else [F.asc("id")]
    return pages.page(found, [F.desc("score"), F.asc("source"), *date], number, per_page).drop("date_depicted")


def semantic(c: Corpus, vectors: DataFrame, asked: DataFrame, typed: str, filters: Filters = Filters()) -> DataFrame:
    """V1, V2: live documents by likeness to the question's vector: (record_type, id, title, score, snippet, source).

    vectors and asked: (id, slot, weight) as `text.embedding` gives them. Where the question has no vector, or no
    document that passes the filters has one, the keyword search answers, without the filter for an archive.
    """
    if text.escaped(typed)[0] == "empty":
        return browsed(c, filters)
    docs = filters.of(c.docs, "document_id", c.document_tags, c.document_entities)
    held = docs.join(vectors.select("id").distinct(), "id", "left_semi")
    if asked.isEmpty() or held.isEmpty():
        return keyword(c, typed, Filters(filters.tags, filters.entity_id))
    question = F.broadcast(asked.select("slot", F.col("weight").alias("q")))  # one vector: a row for each of its dimensions at most
    dots = vectors.join(question, "slot").groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("dot"))
    scored = _shown(held, "document").join(dots, "id", "left").withColumns({"score": F.coalesce("dot", F.lit(0.0)), "snippet": F.lit(""), "source": F.lit(1)})
    return scored.select("record_type", "id", "title", "score", "snippet", "source")
