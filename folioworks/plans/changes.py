"""Queries over changes: states after mutations, compared with their oracles (M-operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import extraction, groups, ledger, network
from folioworks.plans.ctes import DOC_ENTS, DOCS, GROUPS, LIVE, TAGS, TXNS, sql
from folioworks.plans.registry import query
from folioworks.sources.archive import Archive


def _q(name, *parts):
    def put(fn):
        query(name, sql(*parts))(lambda spark, folder: fn(Archive(spark, folder)))
        return fn

    return put


@_q("group_create", DOCS, "SELECT custkey AS group_id, id AS document_id, CAST(row_number() OVER (PARTITION BY custkey ORDER BY title) AS INT) AS page FROM docs WHERE source_archive = '2-HIGH' AND custkey IN (SELECT custkey FROM docs WHERE source_archive = '2-HIGH' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)")
def group_create(a):
    """New groups of 2 to 50 ungrouped documents, pages by title."""
    free = a.documents.where("source_archive = '2-HIGH' and group_id is null").select(F.col("custkey").alias("group_id"), F.col("id").alias("document_id"), "title")
    fit = free.groupBy("group_id").agg(F.count("*").alias("n")).where("n between 2 and 50")
    return groups.numbered(free.join(fit, "group_id", "left_semi"), "group_id", "title").select("group_id", "document_id", "page")


@_q("group_reextract", DOCS, GROUPS, "SELECT id, title || CASE WHEN id % 2 = 0 THEN ' (revised)' ELSE '' END AS title FROM grps")
def group_reextract(a):
    """Replaced by key."""
    old = a.groups.select("id", "title", F.lit(0).alias("version"))
    new = old.where("id % 2 = 0").select("id", F.concat("title", F.lit(" (revised)")).alias("title"), F.lit(1).alias("version"))
    return ledger.latest(old.unionByName(new), ["id"], ["version"]).select("id", "title")


@_q("group_delete_reverts_pages", DOCS, "SELECT id, CASE WHEN group_id % 5 <> 0 THEN group_id END AS group_id, page_number FROM docs WHERE group_id IS NOT NULL")
def group_delete_reverts_pages(a):
    """Pages of deleted groups stand alone and keep their number."""
    pages = a.documents.where("group_id is not null").select("id", "group_id", F.col("page_number").cast("long").alias("page_number"))
    return pages.withColumn("group_id", F.when(F.col("group_id") % 5 != 0, F.col("group_id")))


@_q("entity_attach_detach", DOC_ENTS, "SELECT role, count(*) AS n FROM (SELECT document_id, entity_id, role FROM dents WHERE role <> 'lot' UNION SELECT document_id, 4000001, 'origin' FROM dents WHERE role = 'buyer' AND document_id % 3 = 0) GROUP BY 1")
def entity_attach_detach(a):
    """All lots detached, one place attached where it isn't yet."""
    left = a.document_entities.where("role <> 'lot'")
    new = left.where("role = 'buyer' and document_id % 3 = 0").select("document_id", F.lit(4_000_001).cast("long").alias("entity_id"), F.lit("origin").alias("role"))
    return ledger.insert_or_ignore(left, new, ["document_id", "entity_id", "role"]).groupBy("role").agg(F.count("*").alias("n"))


@_q("txn_crud", TXNS, "SELECT seller, round(sum(CASE WHEN lot_number = '2' THEN price * 2 ELSE price END), 2) AS total, count(*) AS n FROM txns WHERE lot_number <> '3' GROUP BY 1")
def txn_crud(a):
    """Lots 2 repriced from text, lots 3 deleted."""
    text = F.concat(F.lit(" "), (F.col("price") * 2).cast("string"))
    t = ledger.patched(a.transactions, F.col("lot_number") == "2", {"price": exprs.price(text)}, ("price",)).where("lot_number <> '3'")
    return t.groupBy("seller").agg(F.round(F.sum("price"), 2).alias("total"), F.count("*").alias("n"))


@_q("tag_crud", TAGS, "SELECT tag, count(*) AS n FROM (SELECT document_id, CASE WHEN tag = (SELECT min(tag) FROM dtags) THEN 'renamed' ELSE tag END AS tag FROM dtags) GROUP BY 1")
def tag_crud(a):
    """M18"""
    first = a.document_tags.agg(F.min("tag").alias("first"))
    return a.document_tags.crossJoin(first).groupBy(F.when(F.col("tag") == F.col("first"), "renamed").otherwise(F.col("tag")).alias("tag")).agg(F.count("*").alias("n"))  # first: one row


@_q("link_crud", DOCS, "SELECT id AS source_id, id + 1 AS target_id, 'next' AS relationship_type FROM docs WHERE id % 4 = 0 AND id + 1 IN (SELECT id FROM docs)")
def link_crud(a):
    """Links to the next record; repeats and links to nothing are refused."""
    ids = a.documents.select("id")
    new = ids.where("id % 4 = 0").select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("next").alias("relationship_type"))
    known = new.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "relationship_type")
    return ledger.insert_or_ignore(known.where("source_id % 8 = 0"), known, ["source_id", "target_id", "relationship_type"])


@_q("alias_crud", "SELECT n_nationkey AS entity_id, lower(n_name) || ' old' AS alias FROM nation WHERE n_nationkey % 2 = 1")
def alias_crud(a):
    """Aliases added for all, removed for even ones."""
    return a.raw("nation").select(F.col("n_nationkey").alias("entity_id"), exprs.normalized_name(F.concat("n_name", F.lit("  Old"))).alias("alias")).where("entity_id % 2 = 1")


@_q("medium_backfill", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'telegram' WHEN 1 THEN 'inventory' ELSE 'other' END AS category FROM part")
def medium_backfill(a):
    """A given category that is none gives way to the medium's."""
    given = F.when(F.col("p_size") % 3 == 1, "inventory").otherwise("nonsense")
    medium = F.when(F.col("p_size") % 3 == 0, "A Cable").otherwise("")
    return a.raw("part").select("p_partkey", exprs.chosen_category(given, medium).alias("category"))


@_q("touch_updated_at", DOCS, "SELECT id, CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS touched FROM docs")
def touch_updated_at(a):
    """Rows that a patch changes get its time."""
    old = a.documents.withColumn("updated_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    new = ledger.patched(old, F.col("id") % 11 == 0, {"source_archive": F.lit("Box"), "updated_at": F.current_timestamp()}, ("source_archive", "updated_at"))
    return new.select("id", (F.year("updated_at") > 1970).cast("int").alias("touched"))


@_q("group_role_lookup", DOCS, DOC_ENTS, "SELECT d.group_id, arg_min(role, page_number * 100 + CASE role WHEN 'buyer' THEN 1 WHEN 'lot' THEN 2 WHEN 'origin' THEN 3 ELSE 4 END) AS role FROM docs d JOIN dents ON document_id = d.id WHERE group_id IS NOT NULL GROUP BY 1")
def group_role_lookup(a):
    """The first role in page order."""
    pages = a.documents.where("group_id is not null").select("group_id", "page_number", F.col("id").alias("document_id"))
    return pages.join(a.document_entities, "document_id").groupBy("group_id").agg(F.min_by("role", F.struct("page_number", "role")).alias("role"))


@_q("edge_evidence edge_evidence_all", DOCS, GROUPS, LIVE, DOC_ENTS, "SELECT a.entity_id AS source, b.entity_id AS target, document_id AS id, title FROM (SELECT * FROM dents WHERE role = 'seller') a JOIN (SELECT * FROM dents WHERE role = 'buyer') b USING (document_id) JOIN live ON live.id = document_id")
def edge_evidence(a):
    """J24"""
    one = a.document_entities.where("role = 'seller'").select("document_id", F.col("entity_id").alias("source"))
    two = a.document_entities.where("role = 'buyer'").select("document_id", F.col("entity_id").alias("target"))
    edges = one.join(two, "document_id").groupBy("source", "target").agg(F.collect_list("document_id").alias("evidence_doc_ids"))
    return extraction.evidence(edges, a.standalone)


@_q("dangling_edges", DOC_ENTS, "SELECT DISTINCT a.entity_id AS source, b.entity_id AS target FROM dents a JOIN dents b ON a.document_id = b.document_id AND a.role = 'seller' AND b.role = 'buyer' WHERE a.entity_id % 7 = 0 AND b.entity_id % 5 = 0")
def dangling_edges(a):
    """Edges whose ends are both shown."""
    one = a.document_entities.where("role = 'seller'").select("document_id", F.col("entity_id").alias("source"))
    two = a.document_entities.where("role = 'buyer'").select("document_id", F.col("entity_id").alias("target"))
    edges = one.join(two, "document_id").select("source", "target").distinct()
    ids = a.document_entities.select("entity_id").distinct()
    shown = ids.where("(entity_id < 2000000 and entity_id % 7 = 0) or (entity_id >= 2000000 and entity_id % 5 = 0)").withColumn("doc_count", F.lit(1))
    return network.capped(shown, edges, 1_000_000)[1].select("source", "target")
