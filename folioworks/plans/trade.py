"""Queries over the trade world: timeline, records, entities, network."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import entities, ledger, network, records, timeline
from folioworks.plans.ctes import DOC_ENTS, DOCS, ENTITIES, GROUP_ENTS, GROUPS, LABEL, LIVE, SCORE, TAGS, TXNS, sql
from folioworks.plans.registry import query
from folioworks.sources.archive import Archive

SEED = 1_000_002
_EVENTS = "CAST(is_key_evidence AS INT) AS is_key_evidence"
_TRANSFERS = f"SELECT 'transaction' AS event_type, 'document' AS record_type, document_id AS record_id, date, title, {LABEL} AS label, CAST({SCORE} AS INT) AS score, {_EVENTS}, CAST(0 AS INT) AS source_order FROM txns JOIN live ON live.id = document_id WHERE date IS NOT NULL"
_DOC = f"SELECT 'document' AS event_type, 'document' AS record_type, id AS record_id, date_depicted AS date, title, title AS label, CAST(NULL AS INT) AS score, {_EVENTS}, CAST(2 AS INT) AS source_order FROM live"
_GRP = "SELECT 'document' AS event_type, 'group' AS record_type, id AS record_id, date_depicted AS date, title, title AS label, CAST(NULL AS INT) AS score, CAST(0 AS INT) AS is_key_evidence, CAST(3 AS INT) AS source_order FROM lgrps"
_ALL = f"ev AS ({_TRANSFERS} UNION ALL {_DOC} WHERE trim(date_depicted) <> '' UNION ALL {_GRP} WHERE trim(date_depicted) <> '')"
_DATED = "coalesce(date_depicted, date_range_start)"


def _q(name, *parts):
    """Registers fn(archive) -> DataFrame."""

    def put(fn):
        query(name, sql(*parts) if parts else None)(lambda spark, folder: fn(Archive(spark, folder)))
        return fn

    return put


@_q("timeline_transactions", DOCS, GROUPS, LIVE, TXNS, _TRANSFERS)
def timeline_transactions(a):
    return timeline.transfers(a)


@_q("timeline_documents", DOCS, GROUPS, LIVE, f"{_DOC} WHERE {_DATED} >= '1997-01-01' AND {_DATED} <= '1998-12-31' UNION ALL {_GRP} WHERE {_DATED} >= '1997-01-01' AND {_DATED} <= '1998-12-31'")
def timeline_documents(a):
    return timeline.appearances(a, since="1997-01-01", until="1998-12-31")


@_q("timeline_full", DOCS, GROUPS, LIVE, TXNS, _ALL, "SELECT * FROM ev")
def timeline_full(a):
    return timeline.full(a)


@_q("timeline_by_year", DOCS, GROUPS, LIVE, TXNS, _ALL, "SELECT coalesce(nullif(substring(date, 1, 4), ''), 'Unknown') AS year, count(*) AS events FROM ev GROUP BY 1")
def timeline_by_year(a):
    return timeline.by_year(timeline.full(a))


@_q("timeline_undated", DOCS, GROUPS, LIVE, f"{_DOC} WHERE coalesce(trim(date_depicted), '') = '' UNION ALL {_GRP} WHERE coalesce(trim(date_depicted), '') = ''")
def timeline_undated(a):
    return timeline.undated(a)


@_q("timeline_entity_filtered", DOCS, GROUPS, LIVE, TXNS, DOC_ENTS, f"{_TRANSFERS} AND date >= '1998-01-01' AND document_id IN (SELECT document_id FROM dents WHERE entity_id = {SEED})")
def timeline_entity_filtered(a):
    return timeline.transfers(a, since="1998-01-01", entity_id=SEED)


@_q("timeline_csv", DOCS, GROUPS, LIVE, ENTITIES, DOC_ENTS, "SELECT live.id AS document_id, title, string_agg(DISTINCT name, '; ' ORDER BY name) AS entity_names FROM live LEFT JOIN dents ON document_id = live.id LEFT JOIN ents ON ents.id = entity_id GROUP BY 1, 2")
def timeline_csv(a):
    return timeline.entity_names(a)


@_q("timeline_modes", DOCS, GROUPS, LIVE, TXNS, _ALL, "SELECT event_type, count(*) AS shown, count(*) FILTER (event_type = 'transaction' AND score < 4) AS hidden FROM ev WHERE is_key_evidence = 1 GROUP BY 1")
def timeline_modes(a):
    """P18, A24"""
    weak = (F.col("event_type") == "transaction") & (F.col("score") < 4)
    return timeline.full(a).where("is_key_evidence = 1").groupBy("event_type").agg(F.count("*").alias("shown"), F.count_if(weak).alias("hidden"))


_LIST = "SELECT id, title, date_depicted, source_archive FROM docs WHERE is_trashed = 0 AND group_id IS NULL"


@_q("records_list_filtered", DOCS, TAGS, DOC_ENTS, f"{_LIST} AND {_DATED} >= '1996-01-01' AND {_DATED} <= '1999-12-31' AND source_archive = '2-HIGH' AND id IN (SELECT document_id FROM dtags WHERE tag IN (SELECT min(tag) FROM dtags)) AND id IN (SELECT document_id FROM dents WHERE entity_id BETWEEN 1000001 AND 1000030)")
def records_list_filtered(a):
    first = a.document_tags.agg(F.min("tag").alias("tag"))
    tagged = a.document_tags.join(F.broadcast(first), "tag", "left_semi")  # one row
    linked = a.document_entities.where(F.col("entity_id").between(1_000_001, 1_000_030))
    return records.listed(a.documents, since="1996-01-01", until="1999-12-31", archive="2-HIGH", tagged=tagged, linked=linked).select("id", "title", "date_depicted", "source_archive")


@_q("records_list_paged", DOCS, f"{_LIST} ORDER BY {_DATED} DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def records_list_paged(a):
    return records.page(records.listed(a.documents), records.ordering("date_depicted", True), 3).select("id", "title", "date_depicted", "source_archive")


@_q("records_null_archive", DOCS, f"{_LIST} AND (source_archive IS NULL OR source_archive = '')")
def records_null_archive(a):
    return records.listed(a.documents, archive=records.NONE).select("id", "title", "date_depicted", "source_archive")


@_q("records_sorted_title", DOCS, f"{_LIST} ORDER BY lower(title) NULLS LAST, id LIMIT 200")
def records_sorted_title(a):
    return records.page(records.listed(a.documents), records.ordering("title"), 1, 9999).select("id", "title", "date_depicted", "source_archive")


@_q("trash_view", DOCS, "SELECT id, title, date_depicted, source_archive FROM docs WHERE is_trashed = 1")
def trash_view(a):
    return records.listed(a.documents, trashed=True, hide_grouped=False).select("id", "title", "date_depicted", "source_archive")


@_q("key_evidence", DOCS, f"{_LIST} AND is_key_evidence = 1")
def key_evidence(a):
    return records.listed(a.documents, key_only=True).select("id", "title", "date_depicted", "source_archive")


@_q("lean_projection", DOCS, "SELECT id, title, group_id, page_number FROM docs WHERE is_trashed = 0 AND group_id IS NOT NULL")
def lean_projection(a):
    return records.listed(a.documents, hide_grouped=False).where("group_id is not null").select("id", "title", "group_id", F.col("page_number").cast("long"))


@_q("gallery_merged", DOCS, GROUPS, LIVE, f"SELECT 'document' AS record_type, id, title, {_DATED} AS sort_date FROM live UNION ALL SELECT 'group', id, title, {_DATED} FROM lgrps")
def gallery_merged(a):
    return records.gallery(a)


@_q("record_detail_entities record_detail_entities_all", DOCS, GROUPS, LIVE, ENTITIES, DOC_ENTS, "SELECT document_id, entity_id, name, type, role FROM dents JOIN ents ON ents.id = entity_id JOIN live ON live.id = document_id")
def record_detail_entities(a):
    """The details of every record."""
    ids = a.standalone.select(F.col("id").alias("document_id"))
    return a.document_entities.join(ids, "document_id", "left_semi").join(a.entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").select("document_id", "entity_id", "name", "type", "role")


@_q("record_detail_links", DOCS, "SELECT a.id AS source_id, b.id AS target_id, a.title AS source_title, b.title AS target_title FROM docs a JOIN docs b ON b.group_id = a.group_id AND b.page_number = a.page_number + 1")
def record_detail_links(a):
    """Links between following pages, with both titles."""
    p = a.documents.where("group_id is not null")
    one = p.select("group_id", F.col("id").alias("source_id"), F.col("title").alias("source_title"), (F.col("page_number") + 1).alias("page_number"))
    two = p.select("group_id", "page_number", F.col("id").alias("target_id"), F.col("title").alias("target_title"))
    return one.join(two, ["group_id", "page_number"]).select("source_id", "target_id", "source_title", "target_title")


@_q("groups_list_page_counts", DOCS, GROUPS, LIVE, "SELECT lgrps.id, lgrps.title, count(docs.id) AS page_count, min(docs.id) AS first_page_id FROM lgrps LEFT JOIN docs ON docs.group_id = lgrps.id GROUP BY 1, 2")
def groups_list_page_counts(a):
    return records.group_listing(a)


@_q("group_inherited_archive", DOCS, GROUPS, "SELECT id, source_archive FROM grps")
def group_inherited_archive(a):
    return a.groups.select("id", "source_archive")


@_q("group_detail_entities", DOCS, GROUPS, DOC_ENTS, GROUP_ENTS, "SELECT group_id, entity_id, role, CAST(NULL AS BIGINT) AS first_page FROM gents UNION ALL SELECT d.group_id, e.entity_id, min(e.role), arg_min(d.id, d.page_number) FROM docs d JOIN dents e ON e.document_id = d.id WHERE d.group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gents g WHERE g.group_id = d.group_id AND g.entity_id = e.entity_id) GROUP BY 1, 2")
def group_detail_entities(a):
    """A group's own entities, and those of its pages alone."""
    own = a.group_entities
    pages = a.documents.where("group_id is not null").select("group_id", "page_number", F.col("id").alias("document_id"))
    child = pages.join(a.document_entities, "document_id").join(own.select("group_id", "entity_id"), ["group_id", "entity_id"], "left_anti")
    child = child.groupBy("group_id", "entity_id").agg(F.min("role").alias("role"), F.min_by("document_id", "page_number").alias("first_page"))
    return own.withColumn("first_page", F.lit(None).cast("long")).unionByName(child)


@_q("archives_distinct", DOCS, GROUPS, LIVE, "SELECT source_archive FROM docs WHERE is_trashed = 0 AND trim(source_archive) <> '' UNION SELECT source_archive FROM lgrps WHERE trim(source_archive) <> ''")
def archives_distinct(a):
    return records.archives(a)


@_q("tags_usage", TAGS, "SELECT tag, count(*) AS documents FROM dtags GROUP BY 1 UNION ALL SELECT DISTINCT p_type, 0 FROM part WHERE p_type NOT IN (SELECT tag FROM dtags)")
def tags_usage(a):
    return records.tag_usage(a)


@_q("stats_dashboard", DOCS, GROUPS, LIVE, ENTITIES, DOC_ENTS, GROUP_ENTS, TXNS, TAGS, """alive AS (SELECT id FROM docs WHERE is_trashed = 0)
 SELECT (SELECT count(*) FROM live) + (SELECT count(*) FROM lgrps) AS documents, (SELECT count(*) FROM lgrps) AS groups,
 (SELECT count(*) FROM ents WHERE id IN (SELECT entity_id FROM dents WHERE document_id IN (SELECT id FROM alive) UNION SELECT entity_id FROM gents WHERE group_id IN (SELECT id FROM lgrps))) AS entities,
 (SELECT count(*) FROM txns WHERE document_id IN (SELECT id FROM alive)) AS transactions, (SELECT count(DISTINCT tag) FROM dtags WHERE document_id IN (SELECT id FROM alive)) AS tags,
 (SELECT CAST(sum(is_key_evidence) AS BIGINT) FROM live) AS key_evidence""".replace("alive AS", ", alive AS", 1))
def stats_dashboard(a):
    return records.stats(a)


@_q("pagination_totals", DOCS, TAGS, "SELECT count(*) AS row_count, count(DISTINCT id) AS records FROM docs JOIN dtags ON document_id = id WHERE is_trashed = 0 AND group_id IS NULL")
def pagination_totals(a):
    """A1, A2"""
    return a.standalone.join(a.document_tags.withColumnRenamed("document_id", "id"), "id").agg(F.count("*").alias("row_count"), F.countDistinct("id").alias("records"))


_RECORDS = """rec AS (SELECT e.entity_id, e.document_id AS record_id, 'd' AS kind FROM dents e JOIN docs d ON d.id = e.document_id WHERE d.is_trashed = 0 AND d.group_id IS NULL
 UNION SELECT e.entity_id, d.group_id, 'g' FROM dents e JOIN docs d ON d.id = e.document_id JOIN lgrps g ON g.id = d.group_id WHERE d.is_trashed = 0
 UNION SELECT entity_id, group_id, 'g' FROM gents WHERE group_id IN (SELECT id FROM lgrps))"""
_BASE = (DOCS, GROUPS, LIVE, ENTITIES, DOC_ENTS, GROUP_ENTS)


@_q("entities_doc_count", *_BASE, _RECORDS, "SELECT id, name, type, coalesce(n, 0) AS doc_count FROM ents LEFT JOIN (SELECT entity_id, count(*) AS n FROM rec GROUP BY 1) ON entity_id = id")
def entities_doc_count(a):
    return entities.record_counts(a)


@_q("entity_documents", *_BASE, _RECORDS, f"SELECT kind, record_id, coalesce(live.title, lgrps.title) AS title FROM rec LEFT JOIN live ON kind = 'd' AND live.id = record_id LEFT JOIN lgrps ON kind = 'g' AND lgrps.id = record_id WHERE entity_id = {SEED}")
def entity_documents(a):
    """O4, J15"""
    links = entities.record_links(a).where(F.col("entity_id") == SEED)
    titles = a.standalone.select(F.lit("d").alias("kind"), F.col("id").alias("record_id"), "title").unionByName(a.live_groups.select(F.lit("g").alias("kind"), F.col("id").alias("record_id"), "title"))
    return links.join(titles, ["kind", "record_id"], "left").select("kind", "record_id", "title")


@_q("entity_set_unions", *_BASE, _RECORDS, "SELECT kind, count(*) AS links, count(DISTINCT entity_id) AS entities FROM rec GROUP BY 1")
def entity_set_unions(a):
    return entities.record_links(a).groupBy("kind").agg(F.count("*").alias("links"), F.countDistinct("entity_id").alias("entities"))


@_q("entities_search_alias", ENTITIES, "SELECT id, name, type FROM ents WHERE contains(normalized_name, '00001') OR id IN (SELECT id FROM ents WHERE type = 'place' AND contains(normalized_name || ' land', 'a land'))")
def entities_search_alias(a):
    aliases = a.entities.where("type = 'place'").select(F.col("id").alias("entity_id"), F.concat("normalized_name", F.lit(" land")).alias("normalized_name"))
    return entities.search(a, "00001").select("id", "name", "type").union(entities.search(a, "a land", aliases).select("id", "name", "type")).distinct()


@_q("typeahead_topk", *_BASE, _RECORDS, "SELECT id, name, type, coalesce(n, 0) AS doc_count FROM ents LEFT JOIN (SELECT entity_id, count(*) AS n FROM rec GROUP BY 1) ON entity_id = id WHERE contains(normalized_name, 'supplier') ORDER BY doc_count DESC, name, id LIMIT 20")
def typeahead_topk(a):
    return entities.record_counts(a).where(F.contains(F.lower("name"), F.lit("supplier"))).orderBy(F.desc("doc_count"), "name", "id").limit(20)


@_q("entity_first_match", ENTITIES, "SELECT id, name, type FROM ents WHERE contains(normalized_name, 'customer') ORDER BY id LIMIT 1")
def entity_first_match(a):
    return entities.search(a, "Customer").orderBy("id").limit(1).select("id", "name", "type")


@_q("entity_cooccurrence", *_BASE, _RECORDS, f"""SELECT entity_id, count(*) AS shared FROM (
 SELECT b.entity_id FROM dents a JOIN dents b ON a.document_id = b.document_id AND b.entity_id <> {SEED} WHERE a.entity_id = {SEED} AND a.document_id IN (SELECT id FROM live)
 UNION ALL SELECT b.entity_id FROM rec b WHERE kind = 'g' AND entity_id <> {SEED} AND record_id IN (SELECT record_id FROM rec WHERE kind = 'g' AND entity_id = {SEED})) GROUP BY 1 ORDER BY shared DESC, entity_id LIMIT 20""")
def entity_cooccurrence(a):
    return entities.cooccurring(a, SEED).orderBy(F.desc("shared"), "entity_id").limit(20)


@_q("entity_cooccurrence_simple", DOC_ENTS, f"SELECT b.entity_id, count(*) AS shared FROM dents a JOIN dents b ON a.document_id = b.document_id AND b.entity_id <> {SEED} WHERE a.entity_id = {SEED} GROUP BY 1 ORDER BY shared DESC, b.entity_id LIMIT 10")
def entity_cooccurrence_simple(a):
    return entities.cooccurring_simple(a, SEED).orderBy(F.desc("shared"), "entity_id").limit(10)


@_q("orphan_entities", *_BASE, "SELECT id, name, type FROM ents WHERE id NOT IN (SELECT entity_id FROM dents UNION SELECT entity_id FROM gents)")
def orphan_entities(a):
    return entities.orphans(a).select("id", "name", "type")


@_q("entity_groups_by_type entity_groups_by_type_all", *_BASE, "SELECT document_id, type, string_agg(name, '|' ORDER BY name) AS names FROM dents JOIN ents ON ents.id = entity_id GROUP BY 1, 2")
def entity_groups_by_type(a):
    """A25"""
    named = a.document_entities.join(a.entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id")
    return named.groupBy("document_id", "type").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


_MEMBERS = """mem AS (SELECT 'd' AS kind, document_id AS record_id, entity_id, role FROM dents WHERE document_id IN (SELECT id FROM live)
 UNION ALL SELECT 'g', group_id, entity_id, role FROM gents WHERE group_id IN (SELECT id FROM lgrps)),
 pm AS (SELECT * FROM mem WHERE entity_id IN (SELECT id FROM ents WHERE type IN ('person', 'institution')))"""
_EDGES = """ed AS (SELECT source, target, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(r) AS BIGINT) AS shared_records FROM (SELECT a.kind, a.entity_id AS source, b.entity_id AS target, count(*) AS w, count(DISTINCT a.record_id) AS r
 FROM pm a JOIN pm b ON a.kind = b.kind AND a.record_id = b.record_id AND a.entity_id < b.entity_id GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2)"""
_NODES = "nd AS (SELECT entity_id, count(DISTINCT kind || record_id) AS doc_count FROM pm GROUP BY 1)"
_PEOPLE = ("person", "institution")


@_q("network_nodes", *_BASE, _MEMBERS, _NODES, "SELECT * FROM nd")
def network_nodes(a):
    return network.nodes(network.memberships(a, _PEOPLE))


@_q("network_edges", *_BASE, _MEMBERS, _EDGES, "SELECT * FROM ed")
def network_edges(a):
    return network.edges(network.memberships(a, _PEOPLE), 2)


@_q("network_capped", *_BASE, _MEMBERS, _NODES, _EDGES, "top AS (SELECT entity_id FROM nd ORDER BY doc_count DESC, entity_id LIMIT 60) SELECT ed.* FROM ed WHERE source IN (SELECT entity_id FROM top) AND target IN (SELECT entity_id FROM top)".replace("top AS", ", top AS", 1))
def network_capped(a):
    m = network.memberships(a, _PEOPLE)
    return network.capped(network.nodes(m), network.edges(m, 2), 60)[1].select("source", "target", "weight", "shared_records")


@_q("network_seed_scope", *_BASE, "SELECT id, title FROM live WHERE id IN (SELECT document_id FROM dents WHERE entity_id IN (SELECT entity_id FROM dents WHERE document_id = 1))")
def network_seed_scope(a):
    return network.seed_scope(a, 1)


@_q("network_highlight", *_BASE, _MEMBERS, _NODES, _EDGES, "hit AS (SELECT entity_id FROM nd JOIN ents ON ents.id = entity_id WHERE contains(lower(name), '00003')) SELECT entity_id, CAST(max(m) AS INT) AS matched FROM (SELECT entity_id, 1 AS m FROM hit UNION ALL SELECT target, 0 FROM ed WHERE source IN (SELECT entity_id FROM hit) UNION ALL SELECT source, 0 FROM ed WHERE target IN (SELECT entity_id FROM hit)) GROUP BY 1".replace("hit AS", ", hit AS", 1))
def network_highlight(a):
    m = network.memberships(a, _PEOPLE)
    return network.highlighted(network.nodes(m), network.edges(m, 2), a.entities.select(F.col("id").alias("entity_id"), "name"), "00003")


@_q("network_stats", *_BASE, _MEMBERS, _NODES, _EDGES, "SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges, (SELECT CAST(sum(weight) AS BIGINT) FROM ed) AS weight")
def network_stats(a):
    """G7"""
    m = network.memberships(a, _PEOPLE)
    return network.nodes(m).agg(F.count("*").alias("nodes")).crossJoin(network.edges(m, 2).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")))


@_q("relationship_pairs", *_BASE, _MEMBERS, "SELECT a.entity_id AS source, b.entity_id AS target, count(*) AS mentions, count(DISTINCT a.kind || a.record_id) AS records FROM pm a JOIN pm b ON a.kind = b.kind AND a.record_id = b.record_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 3")
def relationship_pairs(a):
    """Pairs by documents and groups together."""
    e = network.edges(network.memberships(a, _PEOPLE), 1)
    return e.where("weight >= 3").select("source", "target", F.col("weight").alias("mentions"), F.col("shared_records").alias("records"))


@_q("relationship_evidence_topk", *_BASE, _MEMBERS, _EDGES, "SELECT * FROM (SELECT source, target, a.kind, a.record_id, CAST(row_number() OVER (PARTITION BY source, target ORDER BY a.kind, a.record_id) AS INT) AS rank FROM ed JOIN (SELECT DISTINCT kind, record_id, entity_id FROM pm) a ON a.entity_id = source JOIN (SELECT DISTINCT kind, record_id, entity_id FROM pm) b ON b.entity_id = target AND a.kind = b.kind AND a.record_id = b.record_id) WHERE rank <= 8")
def relationship_evidence_topk(a):
    m = network.memberships(a, _PEOPLE)
    return network.evidence(m, network.edges(m, 2))


_TYPED = "ty AS (SELECT DISTINCT suppkey + 1000000 AS source, o_custkey + 2000000 AS target, 'sold to' AS verb FROM txns JOIN orders ON o_orderkey = document_id WHERE seller IS NOT NULL UNION SELECT DISTINCT o_custkey + 2000000, suppkey + 1000000, 'bought from' FROM txns JOIN orders ON o_orderkey = document_id WHERE auction_house IS NOT NULL)"


def _typed(a):
    t = a.transactions.join(a.documents.select(F.col("id").alias("document_id"), "custkey"), "document_id")
    sold = t.where("seller is not null").select((F.col("suppkey") + 1_000_000).alias("source"), (F.col("custkey") + 2_000_000).alias("target"), F.lit("sold to").alias("verb"))
    bought = t.where("auction_house is not null").select((F.col("custkey") + 2_000_000).alias("source"), (F.col("suppkey") + 1_000_000).alias("target"), F.lit("bought from").alias("verb"))
    return sold.union(bought).distinct()


@_q("typed_edges_visible", *_BASE, TXNS, _TYPED, "SELECT ty.* FROM ty WHERE source IN (SELECT id FROM ents WHERE type = 'person') AND target IN (SELECT id FROM ents WHERE type = 'person')")
def typed_edges_visible(a):
    """G5, J23"""
    people = a.entities.where("type = 'person'").select("id")
    return _typed(a).join(people.select(F.col("id").alias("source")), "source", "left_semi").join(people.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "verb")


@_q("parallel_edges", *_BASE, TXNS, _TYPED, "SELECT source, target, verb, CAST(row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY verb, source) - 1 AS INT) AS edge_index, count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) AS edge_total FROM ty")
def parallel_edges(a):
    return network.parallel(_typed(a))


@_q("txn_scores", TXNS, f"SELECT CAST({SCORE} AS INT) AS score, CASE WHEN {SCORE} >= 3 THEN 'green' WHEN {SCORE} = 2 THEN 'amber' ELSE 'red' END AS band, count(*) AS n FROM txns GROUP BY 1, 2")
def txn_scores(a):
    return timeline.scored(a.transactions).groupBy("score", exprs.score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@_q("txn_labels", TXNS, f"SELECT {LABEL} AS label, count(*) AS n FROM txns GROUP BY 1")
def txn_labels(a):
    return timeline.scored(a.transactions).groupBy("label").agg(F.count("*").alias("n"))


@_q("txn_weak_counts", TXNS, f"SELECT count(*) AS total, count(*) FILTER ({SCORE} < 4) AS weak FROM txns")
def txn_weak_counts(a):
    return ledger.weak(a.transactions, 4).agg(F.count("*").alias("total"), F.count_if("weak").alias("weak"))


@_q("weak_purge_preview", TXNS, f"SELECT document_id, lot_number, CAST({SCORE} AS INT) AS score, count(*) AS n FROM txns WHERE {SCORE} < 3 GROUP BY 1, 2, 3")
def weak_purge_preview(a):
    return ledger.weak(a.transactions, 3).where("weak").groupBy("document_id", "lot_number", "score").agg(F.count("*").alias("n"))


@_q("txns_ordered txns_ordered_all", TXNS, "SELECT document_id, date, price, CAST(row_number() OVER (PARTITION BY document_id ORDER BY date NULLS LAST, price, lot_number) AS INT) AS place FROM txns")
def txns_ordered(a):
    """O16"""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy(F.col("date").asc_nulls_last(), "price", "lot_number")
    return a.transactions.withColumn("place", F.row_number().over(order)).select("document_id", "date", "price", "place")


@_q("entity_merge entity_merge_all", DOC_ENTS, "SELECT entity_id, role, count(*) AS documents FROM (SELECT DISTINCT document_id, CASE WHEN entity_id = 1000002 THEN 1000001 ELSE entity_id END AS entity_id, role FROM dents) GROUP BY 1, 2")
def entity_merge(a):
    return entities.merged(a.document_entities, 1_000_001, 1_000_002).groupBy("entity_id", "role").agg(F.count("*").alias("documents"))


@_q("entity_upsert_resolution", ENTITIES, """wanted AS (SELECT DISTINCT lower(s_name) AS normalized_name, 'person' AS type FROM supplier UNION SELECT DISTINCT lower(n_name) || ' land', 'place' FROM nation),
 al AS (SELECT id, normalized_name || ' land' AS normalized_name FROM ents WHERE type = 'place' AND id % 2 = 0),
 f AS (SELECT w.normalized_name, w.type, e.id AS by_name, al.id AS by_alias FROM wanted w LEFT JOIN ents e ON e.normalized_name = w.normalized_name AND e.type = w.type LEFT JOIN al ON al.normalized_name = w.normalized_name)
 SELECT normalized_name, type, coalesce(by_name, by_alias) AS id, CASE WHEN by_name IS NOT NULL THEN 'name' ELSE 'alias' END AS how FROM f WHERE coalesce(by_name, by_alias) IS NOT NULL
 UNION ALL SELECT normalized_name, type, (SELECT max(id) FROM ents) + row_number() OVER (ORDER BY normalized_name, type), 'new' FROM f WHERE coalesce(by_name, by_alias) IS NULL""".replace("wanted AS", ", wanted AS", 1))
def entity_upsert_resolution(a):
    names = a.raw("supplier").select(F.col("s_name").alias("name"), F.lit("person").alias("type")).union(a.raw("nation").select(F.concat("n_name", F.lit(" land")), F.lit("place")))
    aliases = a.entities.where("type = 'place' and id % 2 = 0").select(F.col("id").alias("entity_id"), F.concat("normalized_name", F.lit(" land")).alias("normalized_name"))
    return entities.resolved(names, a.entities, aliases)


@_q("alias_add", ENTITIES, "SELECT id AS entity_id, normalized_name || ' x' AS normalized_name FROM ents WHERE type = 'place' AND id % 3 <> 0")
def alias_add(a):
    places = a.entities.where("type = 'place'")
    there = places.where("id % 3 = 0").select(F.col("id").alias("entity_id"), F.concat("normalized_name", F.lit(" x")).alias("normalized_name"))
    offered = places.select(F.col("id").alias("entity_id"), F.concat("name", F.lit("  X ")).alias("name")).union(places.select("id", "name")).union(places.select("id", F.lit(" ")))
    return entities.new_aliases(offered, there, a.entities).select("entity_id", "normalized_name")


@_q("delete_cascade", DOCS, TXNS, DOC_ENTS, "SELECT 'documents' AS t, count(*) AS n FROM docs WHERE is_trashed = 0 UNION ALL SELECT 'transactions', count(*) FROM txns WHERE document_id NOT IN (SELECT id FROM docs WHERE is_trashed = 1) UNION ALL SELECT 'links', count(*) FROM dents WHERE document_id NOT IN (SELECT id FROM docs WHERE is_trashed = 1)")
def delete_cascade(a):
    docs, kids = ledger.cascaded(a.documents, {"transactions": a.transactions, "links": a.document_entities}, a.documents.where("is_trashed = 1"))
    out = docs.agg(F.count("*").alias("n")).select(F.lit("documents").alias("t"), "n")
    for name, df in kids.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n"))
    return out


@_q("wipe_metadata", DOCS, "SELECT id, CASE WHEN id % 7 <> 0 THEN date_depicted END AS date_depicted, CASE WHEN id % 7 = 0 THEN 'Extraction failed: metadata wiped' END AS description FROM docs")
def wipe_metadata(a):
    return ledger.wiped(a.documents, F.col("id") % 7 == 0).select("id", "date_depicted", "description")


@_q("patch_batch", DOCS, "SELECT id, CASE WHEN id % 11 = 0 THEN 'Box 11' ELSE source_archive END AS source_archive, title FROM docs")
def patch_batch(a):
    return ledger.patched(a.documents, F.col("id") % 11 == 0, {"source_archive": F.lit("Box 11"), "title": F.lit("not allowed")}, ("source_archive",)).select("id", "source_archive", "title")


@_q("audit_diff", DOCS, "SELECT id, 'source_archive' AS field, source_archive AS old_value, 'Box 11' AS new_value FROM docs WHERE id % 11 = 0 UNION ALL SELECT id, 'title', title, upper(title) FROM docs WHERE id % 11 = 0")
def audit_diff(a):
    new = ledger.patched(a.documents, F.col("id") % 11 == 0, {"source_archive": F.lit("Box 11"), "title": F.upper("title")}, ("source_archive", "title"))
    return ledger.diff(a.documents, new, "id", ["source_archive", "title", "date_depicted"])


@_q("taxonomy_categorize", """SELECT p_partkey, CASE WHEN contains(m, 'letter') THEN 'letter' WHEN contains(m, 'memo') OR contains(m, 'note') THEN 'memo' WHEN contains(m, 'invoice') THEN 'transaction record' WHEN contains(m, 'photo') THEN 'artifact photograph' ELSE 'other' END AS category
 FROM (SELECT p_partkey, lower(p_type) || CASE p_size % 5 WHEN 0 THEN ' letter with invoice' WHEN 1 THEN ' banknote' WHEN 2 THEN ' invoice' WHEN 3 THEN ' photo' ELSE '' END AS m FROM part)""")
def taxonomy_categorize(a):
    tail = F.when(F.col("p_size") % 5 == 0, " Letter with invoice").when(F.col("p_size") % 5 == 1, " banknote").when(F.col("p_size") % 5 == 2, " INVOICE").when(F.col("p_size") % 5 == 3, " photo").otherwise("")
    return a.raw("part").select("p_partkey", exprs.medium_category(F.concat("p_type", tail)).alias("category"))


@_q("mediums_present", "SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'letter' WHEN 1 THEN 'memo' WHEN 2 THEN 'transaction record' WHEN 3 THEN 'artifact photograph' ELSE 'other' END AS category FROM part")
def mediums_present(a):
    """A29, U8"""
    return taxonomy_categorize(a).select("category").where(F.col("category").isin(*exprs.MEDIUM_CATEGORIES)).distinct()


@_q("normalize_names", "SELECT c_custkey, lower('the ' || c_name || ' jr') AS normalized_name FROM customer")
def normalize_names(a):
    return a.raw("customer").select("c_custkey", exprs.normalized_name(F.concat(F.lit(" The  "), "c_name", F.lit("\t\n Jr "))).alias("normalized_name"))


@_q("coerce_price", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN round(p_retailprice, 2) END AS price FROM part")
def coerce_price(a):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("about "), F.col("p_retailprice").cast("string"))).otherwise(F.format_number("p_retailprice", 2))
    return a.raw("part").select("p_partkey", exprs.price(text).alias("price"))


@_q("date_sentinel", DOCS, "SELECT id, CASE WHEN id % 5 <> 0 THEN date_range_start END AS date FROM docs")
def date_sentinel(a):
    return a.documents.select("id", exprs.scrubbed_date(F.when(F.col("id") % 5 == 0, F.lit(" Date Unknown ")).otherwise(F.col("date_range_start"))).alias("date"))


@_q("fuzzy_name_match", "SELECT n_name AS name, r_name AS other FROM nation JOIN region ON contains(upper(r_name), upper(left(n_name, 2)))")
def fuzzy_name_match(a):
    """containment either way; two small dimension tables."""
    n, r = a.raw("nation"), a.raw("region")
    return n.crossJoin(r).where(exprs.contains_either(F.upper(F.left("n_name", F.lit(2))), F.upper("r_name"))).select(F.col("n_name").alias("name"), F.col("r_name").alias("other"))


@_q("verb_confidence_gate", TXNS, _TYPED, "SELECT source, target, verb FROM ty WHERE (source % 10) / 10.0 >= 0.4 AND source <> target")
def verb_confidence_gate(a):
    """F25, M6"""
    raw = _typed(a).withColumns({"verb": F.concat(F.lit(" "), F.upper("verb")), "confidence": F.col("source") % 10 / 10})
    clean = raw.withColumn("verb", F.lower(F.trim("verb"))).where("confidence >= 0.4 and source <> target")
    return ledger.latest(clean, ["source", "target", "verb"], ["confidence"]).select("source", "target", "verb")


@_q("tag_picklist", TAGS, "SELECT DISTINCT tag FROM dtags WHERE contains(lower(tag), 'e') AND tag <> (SELECT min(tag) FROM dtags) ORDER BY tag LIMIT 12")
def tag_picklist(a):
    """P23"""
    chosen = a.document_tags.agg(F.min("tag").alias("tag"))
    return a.document_tags.select("tag").distinct().join(chosen, "tag", "left_anti").where(F.contains(F.lower("tag"), F.lit("e"))).orderBy("tag").limit(12)


@_q("dossier_selection", DOCS, ENTITIES, DOC_ENTS, "SELECT d.id, d.title, string_agg(DISTINCT name, ', ' ORDER BY name) AS entity_names FROM docs d LEFT JOIN dents ON document_id = d.id LEFT JOIN ents ON ents.id = entity_id WHERE d.id IN (1, 2, 3, 5, 8, 13, 21, 34) GROUP BY 1, 2")
def dossier_selection(a):
    """S9, A11, P8"""
    docs = a.documents.where(F.col("id").isin(1, 2, 3, 5, 8, 13, 21, 34))
    names = a.document_entities.join(a.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").withColumnRenamed("document_id", "id")
    return docs.join(names, "id", "left").groupBy("id", "title").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("name")), ", "), F.lit("")).alias("entity_names"))


@_q("entity_history", DOCS, DOC_ENTS, TXNS, f"SELECT d.id, d.title, {_DATED} AS date, count(t.document_id) AS transactions FROM docs d LEFT JOIN txns t ON t.document_id = d.id WHERE d.id IN (SELECT document_id FROM dents WHERE entity_id = {SEED}) AND d.is_trashed = 0 GROUP BY 1, 2, 3")
def entity_history(a):
    """S8"""
    mine = a.document_entities.where(F.col("entity_id") == SEED).select(F.col("document_id").alias("id"))
    docs = a.documents.where("is_trashed = 0").join(mine, "id", "left_semi")
    count = a.transactions.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return docs.join(count, "id", "left").select("id", "title", records.dated().alias("date"), F.coalesce("n", F.lit(0)).alias("transactions"))
