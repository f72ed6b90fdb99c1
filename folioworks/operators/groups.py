"""Groups of pages merged into one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(pages: DataFrame, key: str, order: str) -> DataFrame:
    """W1"""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def transcription(pages: DataFrame) -> DataFrame:
    """Each group's texts in page order, with page markers unless a text has one."""
    marked = F.when(F.contains("text", F.lit("[Page ")), F.col("text")).otherwise(F.concat(F.lit("[Page "), "page", F.lit("]\n"), "text"))
    full = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("group_id", "page", marked.alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda x: x["part"])
    return full.groupBy("group_id").agg(F.array_join(ordered, "\n\n").alias("transcription"), F.count("*").alias("pages"))


def first_filled(pages: DataFrame, field: str) -> DataFrame:
    """The first value that isn't empty, in page order."""
    full = pages.where(F.trim(F.coalesce(field, F.lit(""))) != "")
    return full.groupBy("group_id").agg(F.min_by(field, "page").alias(field))


def most_common(pages: DataFrame, field: str) -> DataFrame:
    """The most frequent value; of ties, the one that stands first."""
    counts = pages.where(F.col(field).isNotNull()).groupBy("group_id", field).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    return counts.groupBy("group_id").agg(F.max_by(field, F.struct("n", -F.col("first"))).alias(field))


def reordered(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages get their place in the given list (group_id, ids); others keep theirs."""
    places = order.select("group_id", F.posexplode("ids").alias("at", "page_id"))
    return pages.join(places, ["group_id", "page_id"], "left").select("group_id", "page_id", F.coalesce(F.col("at") + 1, "page").alias("page"))


def distinct_links(links: DataFrame) -> DataFrame:
    """Each group's entities and roles once, with the context of the earliest page."""
    return links.groupBy("group_id", "entity_id", "role").agg(F.min_by("context", "page").alias("context"))


def date_range(pages: DataFrame) -> DataFrame:
    """The first and the last of the pages' dates, each page's depicted date or else where its range starts."""
    date = F.coalesce(F.nullif("date_depicted", F.lit("")), "date_range_start")
    return pages.groupBy("group_id").agg(F.min(date).alias("date_range_start"), F.max(date).alias("date_range_end"))


def merged_transactions(pages: DataFrame, transactions: DataFrame) -> DataFrame:
    """A group's transactions are all of its pages', repeats too, in order of pages.

    pages: group_id, page, document_id; transactions: document_id, ... Returns group_id, page and the transactions' columns but document_id.
    """
    return pages.select("group_id", "page", "document_id").join(transactions, "document_id").drop("document_id")


def merged_tags(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """A group's tags are its pages', each once."""
    return pages.select("group_id", "document_id").join(tags, "document_id").select("group_id", "tag").distinct()
