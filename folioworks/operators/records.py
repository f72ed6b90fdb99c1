"""Record listings: filters, details, totals, dashboards (P, J, A, O and U operators)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import pages
from folioworks.sources.archive import Archive

NONE = "__none__"
SORTS = ("title", "date_depicted", "id", "source_archive")


def dated() -> Column:
    return exprs.effective_date(F.col("date_depicted"), F.col("date_range_start"))


def between(date: Column, since: str | None, until: str | None) -> Column:
    """Bounds compare as strings; a NULL date passes only without bounds."""
    tests = [date >= since] if since else []
    tests += [date <= until] if until else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def from_archive(name: str | None) -> Column:
    """P6"""
    c = F.col("source_archive")
    return F.lit(True) if name is None else (c.isNull() | (c == "")) if name == NONE else c == name


def of_medium(name: str | None) -> Column:
    """By category; NONE is a record that has neither a category nor a medium."""
    category, medium = F.col("medium_category"), F.col("medium")
    if name == NONE:
        return (category.isNull() | (category == "other")) & (medium.isNull() | (medium == ""))
    return category == name


def listed(
    docs: DataFrame, *, trashed: bool = False, hide_grouped: bool = True, key_only: bool = False, since: str | None = None, until: str | None = None,
    archive: str | None = None, medium: str | None = None, tagged: DataFrame | None = None, linked: DataFrame | None = None,
) -> DataFrame:
    """Records by any of the filters; tag and entity filters are semi joins, so nothing doubles."""
    out = docs.where(F.col("is_trashed") == int(trashed))
    if hide_grouped:
        out = out.where("group_id is null")
    if key_only:
        out = out.where("is_key_evidence = 1")
    out = out.where(between(dated(), since, until) & from_archive(archive))
    if medium is not None:
        out = out.where(of_medium(medium))
    for ids in (tagged, linked):
        if ids is not None:
            out = out.join(ids.select(F.col("document_id").alias("id")), "id", "left_semi")
    return out


def ordering(sort: str, descending: bool = False) -> list[Column]:
    """Unknown keys are the effective date; it and the title put NULL last either way."""
    key = {"title": F.lower("title"), "id": F.col("id"), "source_archive": F.col("source_archive")}.get(sort, dated())
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("id").asc()]


def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int = 50) -> DataFrame:
    """O2"""
    return pages.page(df, order, number, per_page)


def stats(a: Archive) -> DataFrame:
    """A3: the dashboard's six numbers, one row."""
    docs, groups = a.standalone, a.live_groups
    live = a.documents.where("is_trashed = 0").select(F.col("id").alias("document_id"))
    linked = a.document_entities.join(live, "document_id", "left_semi").select("entity_id").union(a.group_entities.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi").select("entity_id"))
    one = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("is_key_evidence"), F.lit(0)).alias("key_evidence"))
    parts = [
        groups.agg(F.count("*").alias("groups")),
        a.entities.select(F.col("id").alias("entity_id")).join(linked.distinct(), "entity_id", "left_semi").agg(F.count("*").alias("entities")),
        a.transactions.join(live, "document_id", "left_semi").agg(F.count("*").alias("transactions")),
        a.document_tags.join(live, "document_id", "left_semi").agg(F.countDistinct("tag").alias("tags")),
    ]
    out = reduce(lambda x, y: x.crossJoin(y), parts, one)  # single rows
    return out.select((F.col("n_docs") + F.col("groups")).alias("documents"), "groups", "entities", "transactions", "tags", "key_evidence")


def archives(a: Archive) -> DataFrame:
    """Archives that a live record names."""
    both = a.documents.where("is_trashed = 0").select("source_archive").union(a.live_groups.select("source_archive"))
    return both.where(~exprs.blank(F.col("source_archive"))).distinct().orderBy(F.lower("source_archive"))


def tag_usage(a: Archive) -> DataFrame:
    """How many documents have each tag, unused tags too; the most used first."""
    tags = a.raw("part").select(F.col("p_type").alias("tag")).distinct()
    return tags.join(a.document_tags, "tag", "left").groupBy("tag").agg(F.count("document_id").alias("documents")).orderBy(F.desc("documents"), "tag")


def group_listing(a: Archive) -> DataFrame:
    """Live groups with their pages, trashed ones too."""
    pages = a.documents.where("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("page_count"), F.min("id").alias("first_page_id"))
    return a.live_groups.join(pages, "id", "left").select("id", "title", F.coalesce("page_count", F.lit(0)).alias("page_count"), "first_page_id")


def gallery(a: Archive) -> DataFrame:
    """Documents and groups together, by title or date."""
    cols = ["record_type", "id", "title", "sort_date"]
    docs = a.standalone.select(F.lit("document").alias("record_type"), "id", "title", dated().alias("sort_date"))
    groups = a.live_groups.select(F.lit("group").alias("record_type"), "id", "title", dated().alias("sort_date"))
    return docs.select(cols).unionByName(groups.select(cols))


def stamped_gallery(a: Archive) -> DataFrame:
    """`gallery` with the times at which records were made and changed."""
    cols = ["record_type", "id", "title", "sort_date", "created_at", "updated_at"]
    docs = a.stamped.where("is_trashed = 0 and group_id is null").select(F.lit("document").alias("record_type"), "id", "title", dated().alias("sort_date"), "created_at", "updated_at")
    groups = a.stamped_groups.where("is_trashed = 0").select(F.lit("group").alias("record_type"), "id", "title", dated().alias("sort_date"), "created_at", "updated_at")
    return docs.select(cols).unionByName(groups.select(cols))


def gallery_page(a: Archive, number: int = 1, per_page: int = 50, by: str = "title", descending: bool = False) -> DataFrame:
    """A page of documents and a page of groups, merged by title, date, updated (or else created) or created; empty ones stand last either way."""
    stamps = by in ("updated", "created")
    key = F.lower("title") if by == "title" else F.coalesce(F.nullif(F.col("updated_at"), F.lit("")), F.col("created_at")) if by == "updated" else F.col("created_at" if stamps else "sort_date")
    key = F.nullif(key, F.lit(""))
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("record_type"), F.col("id")]
    all_ = stamped_gallery(a) if stamps else gallery(a)
    parts = [page(all_.where(F.col("record_type") == kind), order, number, per_page) for kind in ("document", "group")]
    return parts[0].unionByName(parts[1]).orderBy(*order)


def links_of(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document's links, whichever end it is, with the other end's title."""
    ends = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other_id"), F.lit("out").alias("direction"))
    ends = ends.unionByName(links.select(F.col("target_id").alias("id"), F.col("source_id").alias("other_id"), F.lit("in").alias("direction")))
    return ends.join(docs.select(F.col("id").alias("other_id"), F.col("title").alias("other_title")), "other_id")
