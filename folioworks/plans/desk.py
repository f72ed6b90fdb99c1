"""Queries over a desk's work on the archive: media, details, galleries, exports, group records, mutations with all they touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import entities, groups, ledger, network, places, records, timeline
from folioworks.plans.ctes import AUDIT, DESCRIBED, DOC_ENTS, DOCS, ENTITIES, GROUP_ENTS, GROUP_TXNS, GROUPS, LABEL, LIVE, PAGES, SCORE, TAGS, TXNS, sql
from folioworks.plans.registry import query
from folioworks.plans.trade import _BASE, _EDGES, _MEMBERS, _PEOPLE, _RECORDS, SEED
from folioworks.sources import sinks
from folioworks.sources.archive import Archive

_DATED = "coalesce(date_depicted, date_range_start)"


def _q(name, *parts):
    def put(fn):
        query(name, sql(*parts))(lambda spark, folder: fn(Archive(spark, folder)))
        return fn

    return put


def _counted(**tables):
    """(t, n): how many rows each table has."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_FREE = "is_trashed = 0 AND group_id IS NULL"


@_q("records_by_medium", DOCS, DESCRIBED, f"SELECT 'letter' AS asked, id FROM ddocs WHERE {_FREE} AND medium_category = 'letter' UNION ALL SELECT '__none__', id FROM ddocs WHERE {_FREE} AND medium_category = 'other' AND coalesce(medium, '') = ''")
def records_by_medium(a):
    """P7"""
    asked = [records.listed(a.described, medium=m).select(F.lit(m).alias("asked"), "id") for m in ("letter", records.NONE)]
    return asked[0].unionByName(asked[1])


@_q("mediums_in_order", DOCS, DESCRIBED, f"SELECT category, CAST(p AS INT) AS place FROM (SELECT unnest(['letter', 'telegram', 'memo', 'transaction record', 'financial statement', 'inventory', 'artifact photograph', 'other']) AS category, unnest(range(8)) AS p) WHERE category IN (SELECT medium_category FROM ddocs WHERE {_FREE})")
def mediums_in_order(a):
    """Categories that live records have, in the taxonomy's order."""
    place = F.array_position(F.array(*map(F.lit, exprs.MEDIUM_CATEGORIES)), F.col("category")) - 1
    return records.listed(a.described).select(F.col("medium_category").alias("category")).distinct().select("category", place.cast("int").alias("place")).where("place >= 0").orderBy("place")


@_q("label_fallbacks", DOCS, DESCRIBED, "SELECT id, coalesce(nullif(own_title, ''), filename) AS label, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM ddocs JOIN orders ON o_orderkey = id")
def label_fallbacks(a):
    """a record's title or file name, and a date without its time."""
    times = a.raw("orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return a.described.join(times, "id").select("id", exprs.label(F.col("own_title"), F.col("filename")).alias("label"), exprs.display_date(F.col("at")).alias("shown"))


@_q("lot_numbers", "SELECT l_linenumber % 4 AS given, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_linenumber % 4 AS VARCHAR) END AS lot, count(*) AS n FROM lineitem GROUP BY 1, 2")
def lot_numbers(a):
    """an empty lot is none."""
    given = F.col("l_linenumber") % 4
    return a.raw("lineitem").groupBy(given.alias("given"), exprs.lot_number(F.when(given == 0, "").otherwise(given.cast("string"))).alias("lot")).agg(F.count("*").alias("n"))


@_q("file_names", "SELECT page_id, 'my_scan_' || page_id AS stem, left('my_scan_' || page_id || '_' || repeat('x', 40), 40) AS safe, CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.tif' WHEN 2 THEN '.webp' ELSE '.bmp' END AS suffix, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS media_type FROM pages")
def file_names(a):
    """stems, safe names, suffixes and media types; an unknown suffix counts as JPEG."""
    tail = F.element_at(F.array(*map(F.lit, (".PNG", ".tif", ".Webp", ".bmp"))), (F.col("page_id") % 4 + 1).cast("int"))
    p = a.raw("pages").select("page_id", F.concat(F.lit("dir/my_scan_"), "page_id", tail).alias("path"))
    safe = exprs.safe_name(F.concat(F.lit("my scan "), "page_id", F.lit(" "), F.repeat(F.lit("x"), F.lit(40))))
    return p.select("page_id", exprs.stem(F.col("path")).alias("stem"), safe.alias("safe"), exprs.suffix(F.col("path")).alias("suffix"), exprs.media_type(F.col("path")).alias("media_type"))


@_q("questions_accepted", "SELECT conv_id, turn, trim(text) <> '' AND length(text) <= 2000 AS accepted FROM conversations WHERE text IS NOT NULL")
def questions_accepted(a):
    """F29"""
    return a.raw("conversations").where("text is not null").select("conv_id", "turn", exprs.valid_question(F.col("text")).alias("accepted"))


@_q("entity_detail_records", DOCS, GROUPS, LIVE, DOC_ENTS, GROUP_ENTS, f"""SELECT * FROM (SELECT 'd' AS kind, id, title FROM live WHERE id IN (SELECT document_id FROM dents WHERE entity_id = {SEED}) ORDER BY date_depicted NULLS LAST, id LIMIT 50)
 UNION ALL SELECT * FROM (SELECT 'g', id, title FROM lgrps WHERE id IN (SELECT group_id FROM docs JOIN dents ON document_id = docs.id WHERE entity_id = {SEED} UNION SELECT group_id FROM gents WHERE entity_id = {SEED}) ORDER BY date_depicted NULLS LAST, id LIMIT 50)""")
def entity_detail_records(a):
    """At most fifty documents and fifty groups, undated ones last."""
    scope = network.scope(a, entity_id=SEED)
    out = None
    for kind, rows in (("d", a.standalone), ("g", a.live_groups)):
        mine = rows.join(scope.where(F.col("kind") == kind).select(F.col("record_id").alias("id")), "id", "left_semi")
        mine = mine.orderBy(F.asc_nulls_last("date_depicted"), "id").limit(50).select(F.lit(kind).alias("kind"), "id", "title")
        out = mine if out is None else out.unionByName(mine)
    return out


@_q("entity_documents_sorted", *_BASE, _RECORDS, f"SELECT kind, record_id, coalesce(live.title, lgrps.title) AS title, coalesce(live.date_depicted, live.date_range_start, lgrps.date_depicted, lgrps.date_range_start, '') AS sort_date FROM rec LEFT JOIN live ON kind = 'd' AND live.id = record_id LEFT JOIN lgrps ON kind = 'g' AND lgrps.id = record_id WHERE entity_id = {SEED}")
def entity_documents_sorted(a):
    """By effective date, records without one first."""
    links = entities.record_links(a).where(F.col("entity_id") == SEED)
    rows = records.gallery(a).select(F.left("record_type", F.lit(1)).alias("kind"), F.col("id").alias("record_id"), "title", "sort_date")
    return links.join(rows, ["kind", "record_id"], "left").select("kind", "record_id", "title", F.coalesce("sort_date", F.lit("")).alias("sort_date")).orderBy("sort_date", "kind", "record_id")


_GALLERY = "SELECT * FROM (SELECT '{0}' AS record_type, id, title, {1} AS sort_date FROM {2} ORDER BY nullif({1}, '') DESC NULLS LAST, id LIMIT 30 OFFSET 30)"


@_q("gallery_paged", DOCS, GROUPS, LIVE, _GALLERY.format("document", _DATED, "live") + " UNION ALL " + _GALLERY.format("group", _DATED, "lgrps"))
def gallery_paged(a):
    """The second page, the latest first."""
    return records.gallery_page(a, 2, 30, "date", True)


@_q("browse_records_and_groups", DOCS, GROUPS, LIVE, "SELECT * FROM (SELECT 'document' AS record_type, id, title FROM live WHERE source_archive = '5-LOW' ORDER BY date_depicted DESC NULLS LAST, id DESC LIMIT 50) UNION ALL SELECT * FROM (SELECT 'group', id, title FROM lgrps WHERE source_archive = '1-URGENT' ORDER BY date_depicted DESC NULLS LAST, id DESC LIMIT 50)")
def browse_records_and_groups(a):
    """Documents, then groups."""
    out = None
    for kind, rows, archive in (("document", a.standalone, "5-LOW"), ("group", a.live_groups, "1-URGENT")):
        mine = rows.where(records.from_archive(archive)).orderBy(F.desc_nulls_last("date_depicted"), F.desc("id")).limit(50)
        mine = mine.select(F.lit(kind).alias("record_type"), "id", "title")
        out = mine if out is None else out.unionByName(mine)
    return out


@_q("run_listing", AUDIT, "SELECT run_id, count(*) AS files, min(ts) AS started FROM audit GROUP BY 1 ORDER BY run_id DESC LIMIT 10")
def run_listing(a):
    """The latest runs."""
    return a.audit.groupBy("run_id").agg(F.count("*").alias("files"), F.min("ts").alias("started")).orderBy(F.desc("run_id")).limit(10)


@_q("run_file_page", AUDIT, "SELECT event_id, status FROM audit WHERE run_id = 7 ORDER BY event_id LIMIT 40 OFFSET 20")
def run_file_page(a):
    """A page of one run's files."""
    return a.audit.where("run_id = 7").orderBy("event_id").offset(20).limit(40).select("event_id", "status")


@_q("run_groups_titles", AUDIT, DOCS, GROUPS, "SELECT run_id, group_id, grps.title, count(DISTINCT docs.id) AS documents, count(DISTINCT entity_id) AS files FROM audit JOIN docs ON docs.id = event_id JOIN grps ON grps.id = docs.group_id WHERE status = 'ok' GROUP BY 1, 2, 3")
def run_groups_titles(a):
    """Files, documents and groups."""
    pages = a.documents.where("group_id is not null").select(F.col("id").alias("event_id"), "group_id")
    named = a.audit.where("status = 'ok'").join(pages, "event_id").join(a.groups.select(F.col("id").alias("group_id"), "title"), "group_id")
    return named.groupBy("run_id", "group_id", "title").agg(F.countDistinct("event_id").alias("documents"), F.countDistinct("entity_id").alias("files"))


_LINKS = "lk AS (SELECT a.id AS source_id, b.id AS target_id FROM docs a JOIN docs b ON b.group_id = a.group_id AND b.page_number = a.page_number + 1)"


def _links(a):
    p = a.documents.where("group_id is not null")
    one = p.select("group_id", F.col("id").alias("source_id"), (F.col("page_number") + 1).alias("page_number"))
    return one.join(p.select("group_id", "page_number", F.col("id").alias("target_id")), ["group_id", "page_number"]).select("source_id", "target_id")


@_q("links_both_ways", DOCS, _LINKS, "SELECT source_id AS id, target_id AS other_id, 'out' AS direction, title AS other_title FROM lk JOIN docs ON docs.id = target_id UNION ALL SELECT target_id, source_id, 'in', title FROM lk JOIN docs ON docs.id = source_id")
def links_both_ways(a):
    """J6, G9"""
    return records.links_of(_links(a), a.documents).select("id", "other_id", "direction", "other_title")


@_q("links_deleted", DOCS, _LINKS, "SELECT * FROM lk WHERE source_id NOT IN (SELECT id FROM docs WHERE is_trashed = 1) AND target_id NOT IN (SELECT id FROM docs WHERE is_trashed = 1)")
def links_deleted(a):
    """Links go with either end."""
    gone = a.documents.where("is_trashed = 1")
    return _links(a).join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id")


_GTRANSFERS = f"SELECT 'transaction' AS event_type, 'group' AS record_type, group_id AS record_id, date, title, {LABEL} AS label, CAST({SCORE} AS INT) AS score, CAST(0 AS INT) AS is_key_evidence, CAST(1 AS INT) AS source_order FROM gtxns JOIN lgrps ON lgrps.id = group_id WHERE date IS NOT NULL"


@_q("timeline_group_transactions", DOCS, GROUPS, LIVE, TXNS, GROUP_TXNS, _GTRANSFERS)
def timeline_group_transactions(a):
    """J5"""
    return timeline.group_transfers(a)


@_q("timeline_ordered", DOCS, GROUPS, LIVE, TXNS, GROUP_TXNS, f"""ev AS (SELECT CAST(0 AS INT) AS source_order, document_id AS record_id, date, {LABEL} AS label FROM txns JOIN live ON live.id = document_id UNION ALL SELECT 1, group_id, date, {LABEL} FROM gtxns JOIN lgrps ON lgrps.id = group_id
 UNION ALL SELECT 2, id, date_depicted, title FROM live UNION ALL SELECT 3, id, date_depicted, title FROM lgrps) SELECT * FROM ev WHERE trim(date) <> '' ORDER BY date, source_order, record_id, label LIMIT 5000""".replace("ev AS", ", ev AS", 1))
def timeline_ordered(a):
    """The first five thousand events."""
    return timeline.ordered(a).select("source_order", "record_id", "date", "label").limit(5000)


_CSV = ", ".join(f"'' AS {c}" for c in ("location", "notes"))


@_q("timeline_file_rows", DOCS, GROUPS, LIVE, TXNS, ENTITIES, DOC_ENTS, f"""nm AS (SELECT document_id, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM dents JOIN ents ON ents.id = entity_id GROUP BY 1)
 SELECT date, 'transaction' AS type, {LABEL} AS label, CAST(document_id AS VARCHAR) AS doc_id, title AS doc_title, coalesce(seller, '') AS seller, coalesce(buyer, '') AS buyer, '' AS price, currency, coalesce(auction_house, '') AS auction_house, lot_number, {_CSV}, CAST({SCORE} AS VARCHAR) AS score, names AS entity_names, '' AS medium, CAST(is_key_evidence AS VARCHAR) AS is_key_evidence
 FROM txns JOIN live ON live.id = document_id JOIN nm USING (document_id) WHERE date IS NOT NULL""".replace("nm AS", ", nm AS", 1))
def timeline_file_rows(a):
    """Rows of a timeline file, all seventeen columns; prices are written as they are and left out here."""
    names = a.document_entities.join(a.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("entity_names"))
    docs = a.standalone.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), "is_key_evidence")
    rows = timeline.scored(a.transactions.where("date is not null").join(docs, "document_id").join(names, "document_id"))
    return sinks.timeline_rows(rows.select(F.lit("transaction").alias("type"), F.col("document_id").alias("doc_id"), *(c for c in rows.columns if c not in ("document_id", "price"))))


@_q("entity_history_blocks", DOCS, DOC_ENTS, TXNS, f"""SELECT 'document' AS part, d.id, CASE WHEN is_key_evidence = 1 THEN '★ KEY EVIDENCE · ' ELSE '' END || coalesce(nullif(date_depicted, ''), nullif(date_range_start, ''), 'Unknown') || ' | ' || title || ' | ' || upper(left(role, 1)) || substring(role, 2) AS line FROM docs d JOIN dents ON document_id = d.id WHERE entity_id = {SEED} AND is_trashed = 0
 UNION ALL SELECT 'transaction', d.id, concat_ws(' | ', coalesce(date, ''), coalesce(seller, ''), coalesce(buyer, ''), coalesce(auction_house, ''), title) FROM txns t JOIN docs d ON d.id = t.document_id WHERE d.is_trashed = 0 AND d.id IN (SELECT document_id FROM dents WHERE entity_id = {SEED})""")
def entity_history_blocks(a):
    """A line for each document and each transaction of an entity's history, in order of date."""
    mine = a.document_entities.where(F.col("entity_id") == SEED).select(F.col("document_id").alias("id"), "role")
    docs = a.documents.where("is_trashed = 0")
    when = F.coalesce(F.nullif("date_depicted", F.lit("")), F.nullif("date_range_start", F.lit("")), F.lit("Unknown"))
    one = docs.join(mine, "id").select(F.lit("document").alias("part"), "id", F.concat(F.when(F.col("is_key_evidence") == 1, "★ KEY EVIDENCE · ").otherwise(""), F.concat_ws(" | ", when, "title", F.initcap("role"))).alias("line"), when.alias("at"))
    txns = a.transactions.withColumnRenamed("document_id", "id").join(docs.join(mine, "id", "left_semi").select("id", "title"), "id")
    two = txns.select(F.lit("transaction").alias("part"), "id", F.concat_ws(" | ", *(F.coalesce(c, F.lit("")) for c in ("date", "seller", "buyer", "auction_house")), F.col("title")).alias("line"), F.coalesce("date", F.lit("")).alias("at"))
    return one.unionByName(two).orderBy("part", "at", "id").select("part", "id", "line")


_TOOL = (1, 2, 3, 5, 8, 13, 21, 34)


@_q("tool_record_text", DOCS, DESCRIBED, ENTITIES, DOC_ENTS, f"""el AS (SELECT document_id, string_agg('  • ' || name || ' (' || type || ') — ' || role, chr(10) ORDER BY name, role) AS lines FROM dents JOIN ents ON ents.id = entity_id GROUP BY 1)
 SELECT d.id, '# Document #' || d.id || ': ' || title || chr(10) || '**Date:** ' || coalesce({_DATED}, 'Unknown') || chr(10) || '**Medium:** ' || coalesce(nullif(medium, ''), 'Unknown') || chr(10) || '**Key Evidence:** ' || CASE WHEN is_key_evidence = 1 THEN 'Yes' ELSE 'No' END || coalesce(chr(10) || '**Entities Mentioned:**' || chr(10) || lines, '') AS text
 FROM ddocs d LEFT JOIN el ON document_id = d.id WHERE d.id IN {_TOOL}""".replace("el AS", ", el AS", 1))
def tool_record_text(a):
    """Records as text for a tool, by a list of ids."""
    line = F.concat(F.lit("  • "), "name", F.lit(" ("), "type", F.lit(") — "), "role")
    said = a.document_entities.where(F.col("document_id").isin(*_TOOL)).join(a.entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id")
    said = said.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "role", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat_ws("\n", F.concat(F.lit("# Document #"), "id", F.lit(": "), "title"), F.concat(F.lit("**Date:** "), F.coalesce(records.dated(), F.lit("Unknown"))), F.concat(F.lit("**Medium:** "), F.coalesce(F.nullif("medium", F.lit("")), F.lit("Unknown"))), F.concat(F.lit("**Key Evidence:** "), F.when(F.col("is_key_evidence") == 1, "Yes").otherwise("No")), F.concat(F.lit("**Entities Mentioned:**\n"), "lines"))
    return a.described.where(F.col("id").isin(*_TOOL)).join(said, "id", "left").select("id", head.alias("text"))


@_q("tool_entity_text", ENTITIES, DOCS, DOC_ENTS, f"""SELECT place, line FROM (SELECT row_number() OVER (ORDER BY cnt DESC, id) AS place, '  • ' || name || ' (' || type || ') — ' || cnt || ' document(s)' AS line FROM (SELECT e.id, name, type, count(*) AS cnt FROM dents a JOIN dents b ON a.document_id = b.document_id AND b.entity_id <> a.entity_id JOIN ents e ON e.id = b.entity_id WHERE a.entity_id = {SEED} GROUP BY 1, 2, 3)) WHERE place <= 10""")
def tool_entity_text(a):
    """The lines of an entity's companions, as a tool gives them."""
    top = entities.cooccurring_simple(a, SEED).join(a.entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").orderBy(F.desc("shared"), "entity_id").limit(10)
    line = F.concat(F.lit("  • "), "name", F.lit(" ("), "type", F.lit(") — "), "shared", F.lit(" document(s)"))
    ten = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("n"), "entity_id", line.alias("line")))).alias("l"))
    return ten.select(F.posexplode("l").alias("at", "x")).select((F.col("at") + 1).cast("long").alias("place"), "x.line")


@_q("group_child_context", DOCS, GROUPS, DOC_ENTS, GROUP_ENTS, "SELECT d.group_id, e.entity_id, min(e.role) AS role, min(e.role || ' on ' || d.id) AS context, arg_min(d.id, d.page_number) AS first_page FROM docs d JOIN dents e ON e.document_id = d.id WHERE d.group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gents g WHERE g.group_id = d.group_id AND g.entity_id = e.entity_id) GROUP BY 1, 2")
def group_child_context(a):
    """Entities of a group's pages alone, with the least context and the first page."""
    pages = a.documents.where("group_id is not null").select("group_id", "page_number", F.col("id").alias("document_id"))
    child = pages.join(a.document_entities, "document_id").join(a.group_entities.select("group_id", "entity_id"), ["group_id", "entity_id"], "left_anti")
    context = F.concat("role", F.lit(" on "), "document_id")
    return child.groupBy("group_id", "entity_id").agg(F.min("role").alias("role"), F.min(context).alias("context"), F.min_by("document_id", F.struct("page_number", "document_id")).alias("first_page"))


@_q("group_merge_dates", DOCS, "SELECT group_id, min(coalesce(nullif(date_depicted, ''), date_range_start)) AS date_range_start, max(coalesce(nullif(date_depicted, ''), date_range_start)) AS date_range_end FROM docs WHERE group_id IS NOT NULL GROUP BY 1")
def group_merge_dates(a):
    """The first and the last of the pages' dates."""
    return groups.date_range(a.documents.where("group_id is not null"))


@_q("group_merge_union", DOCS, TAGS, TXNS, "SELECT t.group_id, tags, n AS transactions FROM (SELECT group_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM docs JOIN dtags ON document_id = id WHERE group_id IS NOT NULL GROUP BY 1) t JOIN (SELECT group_id, count(*) AS n FROM docs JOIN txns ON document_id = id WHERE group_id IS NOT NULL GROUP BY 1) x ON x.group_id = t.group_id")
def group_merge_union(a):
    """The pages' tags once each, their transactions all."""
    pages = a.documents.where("group_id is not null").select("group_id", F.col("id").alias("document_id"))
    tags = pages.join(a.document_tags, "document_id").groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))
    return tags.join(pages.join(a.transactions, "document_id").groupBy("group_id").agg(F.count("*").alias("transactions")), "group_id")


@_q("weak_counts_by_kind", DOCS, TXNS, GROUP_TXNS, f"SELECT kind, count(*) AS total, count(*) FILTER (s < 4) AS weak, count(*) FILTER (coalesce(CASE WHEN s > 0 THEN s END, 5) >= 2) AS shown FROM (SELECT 'document' AS kind, {SCORE} AS s FROM txns UNION ALL SELECT 'group', {SCORE} FROM gtxns) GROUP BY 1")
def weak_counts_by_kind(a):
    """Of documents and groups; a missing score counts as five."""
    out = None
    for kind, t in (("document", a.transactions), ("group", a.group_transactions)):
        t = ledger.weak(t, 4)
        shown = F.coalesce(F.nullif("score", F.lit(0)), F.lit(5)) >= 2
        one = t.agg(F.count("*").alias("total"), F.count_if("weak").alias("weak"), F.count_if(shown).alias("shown")).select(F.lit(kind).alias("kind"), "total", "weak", "shown")
        out = one if out is None else out.unionByName(one)
    return out


@_q("weak_purge_audit", DOCS, TXNS, GROUP_TXNS, f"SELECT entity_id, score, count(*) AS gone FROM (SELECT document_id AS entity_id, CAST({SCORE} AS INT) AS score FROM txns UNION ALL SELECT group_id, CAST({SCORE} AS INT) FROM gtxns) WHERE score < 3 GROUP BY 1, 2")
def weak_purge_audit(a):
    """The audit rows of a purge, of documents and groups."""
    one, two = (ledger.purged(t, 3, key)[1] for t, key in ((a.transactions, "document_id"), (a.group_transactions, "group_id")))
    return one.unionByName(two).where("old_value is not null").groupBy("entity_id", "score").agg(F.count("*").alias("gone"))


@_q("weak_purge_kept", TXNS, f"SELECT document_id, count(*) AS kept FROM txns WHERE {SCORE} >= 3 GROUP BY 1")
def weak_purge_kept(a):
    """What a purge leaves."""
    return ledger.purged(a.transactions, 3, "document_id")[0].groupBy("document_id").agg(F.count("*").alias("kept"))


@_q("entity_rename", ENTITIES, "SELECT id, CASE WHEN type = 'place' THEN 'The  ' || name ELSE name END AS name, CASE WHEN type = 'place' THEN 'region' ELSE type END AS type, CASE WHEN type = 'place' THEN 'the ' || normalized_name ELSE normalized_name END AS normalized_name FROM ents")
def entity_rename(a):
    """M13"""
    places_ = a.entities.where("type = 'place'")
    return entities.renamed(a.entities, places_.select("id", "type", F.concat(F.lit("The  "), "name").alias("new_name"), F.lit("region").alias("new_type")))


@_q("entity_rename_clashes", ENTITIES, "SELECT normalized_name, type, count(*) AS entities FROM ents WHERE type = 'object' GROUP BY 1, 2 HAVING count(*) > 1")
def entity_rename_clashes(a):
    """Names that a uniqueness rule refuses."""
    return entities.clashes(a.entities).where("type = 'object'")


@_q("entity_delete", *_BASE, f"SELECT 'entities' AS t, count(*) AS n FROM ents WHERE id <> {SEED} UNION ALL SELECT 'documents', count(*) FROM dents WHERE entity_id <> {SEED} UNION ALL SELECT 'groups', count(*) FROM gents WHERE entity_id <> {SEED}")
def entity_delete(a):
    """An entity and all that names it."""
    ids = a.entities.where(F.col("id") == SEED)
    return _counted(**entities.without(ids, {"entities": (a.entities, "id"), "documents": (a.document_entities, "entity_id"), "groups": (a.group_entities, "entity_id")}))


_ALIASES = "al AS (SELECT id AS entity_id, normalized_name || ' inc' AS normalized_name FROM ents WHERE id BETWEEN 1000001 AND 1000010 UNION ALL SELECT 1000001, 'supplier two' UNION ALL SELECT 1000002, 'supplier two')"


@_q("entity_merge_whole", *_BASE, _ALIASES, """SELECT 'alias' AS t, entity_id, normalized_name AS what FROM (SELECT DISTINCT CASE WHEN entity_id = 1000002 THEN 1000001 ELSE entity_id END AS entity_id, normalized_name FROM al UNION SELECT 1000001, normalized_name FROM ents WHERE id = 1000002)
 UNION ALL SELECT 'documents', entity_id, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT document_id, CASE WHEN entity_id = 1000002 THEN 1000001 ELSE entity_id END AS entity_id, role FROM dents) GROUP BY 2
 UNION ALL SELECT 'groups', entity_id, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT group_id, CASE WHEN entity_id = 1000002 THEN 1000001 ELSE entity_id END AS entity_id, role FROM gents) GROUP BY 2""")
def entity_merge_whole(a):
    """Aliases, document links and group links."""
    keep, discard = 1_000_001, 1_000_002
    aliases = a.entities.where("id between 1000001 and 1000010").select(F.col("id").alias("entity_id"), F.concat("normalized_name", F.lit(" inc")).alias("normalized_name"))
    aliases = aliases.union(a.spark.range(keep, discard + 1).select("id", F.lit("supplier two")))
    out = entities.repointed(aliases, a.entities, keep, discard).select(F.lit("alias").alias("t"), "entity_id", F.col("normalized_name").alias("what"))
    for name, links in (("documents", entities.merged(a.document_entities, keep, discard)), ("groups", entities.merged_groups(a.group_entities, keep, discard))):
        out = out.unionByName(links.groupBy("entity_id").agg(F.count("*").cast("string").alias("what")).select(F.lit(name).alias("t"), "entity_id", "what"))
    return out


@_q("delete_cascade_sweep", *_BASE, "SELECT type, count(*) AS entities FROM ents WHERE id IN (SELECT entity_id FROM dents WHERE document_id NOT IN (SELECT id FROM docs WHERE is_trashed = 1) UNION SELECT entity_id FROM gents) GROUP BY 1")
def delete_cascade_sweep(a):
    """After a deletion, entities that nothing names any more go."""
    _, kids = ledger.cascaded(a.documents, {"links": a.document_entities}, a.documents.where("is_trashed = 1"))
    return ledger.swept(a.entities, kids["links"], a.group_entities).groupBy("type").agg(F.count("*").alias("entities"))


@_q("wipe_metadata_children", DOCS, DOC_ENTS, TXNS, TAGS, "SELECT 'entities' AS t, count(*) AS n FROM dents WHERE document_id % 7 <> 0 UNION ALL SELECT 'transactions', count(*) FROM txns WHERE document_id % 7 <> 0 UNION ALL SELECT 'tags', count(*) FROM dtags")
def wipe_metadata_children(a):
    """Entities and transactions of wiped documents go, tags stay."""
    gone = a.documents.where("id % 7 = 0")
    _, kids = ledger.cascaded(a.documents, {"entities": a.document_entities, "transactions": a.transactions}, gone)
    return _counted(**kids, tags=a.document_tags)


@_q("entity_detach_sweep", *_BASE, "SELECT id FROM ents WHERE type <> 'object' AND id IN (SELECT entity_id FROM dents WHERE role <> 'lot' UNION SELECT entity_id FROM gents)")
def entity_detach_sweep(a):
    """Detached entities that nothing else names go; a lot's link names an object, any other one doesn't, whatever ids they share."""
    links = a.document_entities.withColumn("lot", F.col("role") == "lot").where("not lot")
    return ledger.swept(a.entities.withColumn("lot", F.col("type") == "object"), links, a.group_entities.withColumn("lot", F.lit(False)), also=("lot",)).select("id")


@_q("group_txn_crud", DOCS, TXNS, GROUP_TXNS, "SELECT group_id, round(sum(CASE WHEN lot_number = '2' THEN price * 2 ELSE price END), 2) AS total, count(*) AS n FROM gtxns WHERE lot_number <> '3' GROUP BY 1")
def group_txn_crud(a):
    """M17, of groups."""
    t = ledger.patched(a.group_transactions, F.col("lot_number") == "2", {"price": exprs.price((F.col("price") * 2).cast("string"))}, ("price",)).where("lot_number <> '3'")
    return t.groupBy("group_id").agg(F.round(F.sum("price"), 2).alias("total"), F.count("*").alias("n"))


@_q("tag_attach_detach", DOCS, TAGS, "SELECT tag, count(*) AS n FROM (SELECT document_id, tag FROM dtags WHERE tag <> (SELECT max(tag) FROM dtags) AND NOT (tag = (SELECT min(tag) FROM dtags) AND document_id % 2 = 0) UNION SELECT id, 'extra' FROM docs WHERE id % 5 = 0) GROUP BY 1")
def tag_attach_detach(a):
    """One tag attached, one detached here and there, one deleted."""
    ends = a.document_tags.agg(F.min("tag").alias("first"), F.max("tag").alias("last"))  # one row
    left = a.document_tags.crossJoin(ends).where("tag <> last and not (tag = first and document_id % 2 = 0)").select("document_id", "tag")
    new = a.documents.where("id % 5 = 0").select(F.col("id").alias("document_id"), F.lit("extra").alias("tag"))
    return ledger.insert_or_ignore(left, new, ["document_id", "tag"]).groupBy("tag").agg(F.count("*").alias("n"))


@_q("group_create_merged", DOCS, DOC_ENTS, """free AS (SELECT * FROM docs WHERE group_id IS NULL AND is_trashed = 0), ok AS (SELECT custkey FROM free GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
 SELECT f.custkey AS group_id, pages, date_depicted, source_archive, entities FROM (SELECT custkey, count(*) AS pages, min(date_depicted) AS date_depicted, arg_min(source_archive, id) FILTER (trim(source_archive) <> '') AS source_archive FROM free WHERE custkey IN (SELECT custkey FROM ok) GROUP BY 1) f
 LEFT JOIN (SELECT custkey, count(DISTINCT (entity_id, role)) AS entities FROM free JOIN dents ON document_id = free.id GROUP BY 1) e ON e.custkey = f.custkey""".replace("free AS", ", free AS", 1))
def group_create_merged(a):
    """New groups of 2 to 50 free documents, their merged fields and their entities once each."""
    free = a.standalone.select(F.col("custkey").alias("group_id"), F.col("id").alias("document_id"), "date_depicted", "source_archive")
    fit = free.groupBy("group_id").agg(F.count("*").alias("pages"), F.min("date_depicted").alias("date_depicted"), F.min_by("source_archive", F.when(~exprs.blank(F.col("source_archive")), F.col("document_id"))).alias("source_archive")).where("pages between 2 and 50")
    links = free.join(a.document_entities, "document_id").select("group_id", "entity_id", "role").distinct().groupBy("group_id").agg(F.count("*").alias("entities"))
    return fit.join(links, "group_id", "left").select("group_id", "pages", "date_depicted", "source_archive", "entities")


@_q("group_reextract_children", DOCS, GROUPS, GROUP_ENTS, TXNS, GROUP_TXNS, "SELECT 'entity' AS t, group_id, entity_id AS what FROM gents WHERE group_id % 2 = 1 UNION ALL SELECT 'entity', id, 4000001 FROM grps WHERE id % 2 = 0 UNION ALL SELECT 'transactions', group_id, count(*) FROM gtxns WHERE group_id % 2 = 1 GROUP BY 2")
def group_reextract_children(a):
    """A group that is extracted again gets new entities and transactions for its old ones."""
    again = a.groups.where("id % 2 = 0").select(F.col("id").alias("group_id"))
    new = again.select("group_id", F.lit(4_000_001).cast("long").alias("what"))
    kept = a.group_entities.join(again, "group_id", "left_anti").select("group_id", F.col("entity_id").alias("what")).unionByName(new).select(F.lit("entity").alias("t"), "group_id", "what")
    txns = a.group_transactions.join(again, "group_id", "left_anti").groupBy("group_id").agg(F.count("*").alias("what"))
    return kept.unionByName(txns.select(F.lit("transactions").alias("t"), "group_id", "what"))


@_q("batch_apply", DOCS, GROUPS, "SELECT 'document' AS record_type, id, CASE WHEN id % 11 = 0 THEN 'Box 11' ELSE source_archive END AS source_archive FROM docs UNION ALL SELECT 'group', id, CASE WHEN id % 11 = 0 THEN 'Box 11' ELSE source_archive END FROM grps")
def batch_apply(a):
    """One change for a selection of documents and groups."""
    out = None
    for kind, rows in (("document", a.documents), ("group", a.groups)):
        new = ledger.patched(rows, F.col("id") % 11 == 0, {"source_archive": F.lit("Box 11")}, ("source_archive",)).select(F.lit(kind).alias("record_type"), "id", "source_archive")
        out = new if out is None else out.unionByName(new)
    return out


@_q("migrated_archive", AUDIT, DOCS, DESCRIBED, DOC_ENTS, ENTITIES, GROUPS, GROUP_ENTS, "SELECT 'categories' AS t, medium_category AS what, count(*) AS n FROM ddocs GROUP BY 1, 2 UNION ALL SELECT 'files', status, count(*) FROM audit WHERE status <> 'requeued' GROUP BY 1, 2 UNION ALL SELECT 'entities', CASE WHEN type = 'place' THEN 'location' ELSE type END, count(*) FROM ents WHERE id IN (SELECT entity_id FROM dents UNION SELECT entity_id FROM gents) GROUP BY 1, 2")
def migrated_archive(a):
    """A column filled in, rows of a given-up kind dropped, types renamed, orphans swept."""
    old = a.described.drop("medium_category").withColumn("medium_category", exprs.chosen_category(F.lit(None).cast("string"), F.col("medium")))
    parts = [
        old.groupBy(F.lit("categories").alias("t"), F.col("medium_category").alias("what")).agg(F.count("*").alias("n")),
        a.audit.where("status <> 'requeued'").groupBy(F.lit("files").alias("t"), F.col("status").alias("what")).agg(F.count("*").alias("n")),
        ledger.swept(a.entities, a.document_entities, a.group_entities).groupBy(F.lit("entities").alias("t"), F.when(F.col("type") == "place", "location").otherwise(F.col("type")).alias("what")).agg(F.count("*").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_q("requeue_by_description", DOCS, "SELECT id, 'requeue' AS action FROM docs WHERE id % 7 = 0")
def requeue_by_description(a):
    """Wiped documents bear the marker by which the next ingest takes them again."""
    return ledger.wiped(a.documents, F.col("id") % 7 == 0).where(F.startswith("description", F.lit("Extraction failed"))).select("id", F.lit("requeue").alias("action"))


@_q("lean_vectors", "SELECT vec_id, label FROM embeddings")
def lean_vectors(a):
    """Without the vector, which isn't read."""
    return a.raw("embeddings").drop("embedding")


@_q("json_rows", "SELECT n_nationkey AS id, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS body FROM nation")
def json_rows(a):
    """Rows as JSON."""
    return a.raw("nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("body"))


@_q("network_scope", *_BASE, TAGS, f"""SELECT 'd' AS kind, id AS record_id FROM live WHERE {_DATED} >= '1996-01-01' AND id IN (SELECT document_id FROM dents WHERE entity_id = {SEED}) AND id IN (SELECT document_id FROM dtags WHERE tag = 'SMALL BRUSHED')
 UNION ALL SELECT 'g', id FROM lgrps WHERE {_DATED} >= '1996-01-01' AND id IN (SELECT group_id FROM docs JOIN dents ON document_id = docs.id WHERE entity_id = {SEED} UNION SELECT group_id FROM gents WHERE entity_id = {SEED})""")
def network_scope(a):
    """G1: by entity, tag and date."""
    return network.scope(a, entity_id=SEED, tag="SMALL BRUSHED", since="1996-01-01")


@_q("network_seed_neighbours", *_BASE, "SELECT DISTINCT live.id, live.title FROM (SELECT DISTINCT entity_id FROM dents WHERE document_id = 2) s JOIN dents ON dents.entity_id = s.entity_id JOIN live ON live.id = dents.document_id")
def network_seed_neighbours(a):
    """Of another seed than network_seed_scope, with an oracle by joins."""
    return network.seed_scope(a, 2)


@_q("relationship_pair_records", *_BASE, _MEMBERS, "SELECT a.entity_id AS source, b.entity_id AS target, coalesce(string_agg(CASE WHEN a.kind = 'd' THEN a.record_id END, ',' ORDER BY a.record_id), '') AS documents, coalesce(string_agg(CASE WHEN a.kind = 'g' THEN a.record_id END, ',' ORDER BY a.record_id), '') AS groups FROM pm a JOIN pm b ON a.kind = b.kind AND a.record_id = b.record_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 3")
def relationship_pair_records(a):
    """The ids themselves."""
    p = network.pair_records(network.memberships(a, _PEOPLE), 3)
    return p.select("source", "target", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("documents", "groups")))


@_q("relationship_refresh", *_BASE, _MEMBERS, _EDGES, "SELECT 'pairs' AS t, count(*) AS n FROM ed UNION ALL SELECT 'processed', count(*) FROM ed WHERE (source + target) % 10 >= 2 UNION ALL SELECT 'kept', count(*) FROM ed WHERE (source + target) % 10 >= 4")
def relationship_refresh(a):
    """Relations wiped and made again: pairs, those an answer came for, and those sure enough to keep."""
    pairs = network.edges(network.memberships(a, _PEOPLE), 2).withColumn("confidence", (F.col("source") + F.col("target")) % 10 / 10.0)
    answered = pairs.where("confidence >= 0.2").withColumn("verb", F.lit(" Knew "))
    kept = answered.withColumn("verb", F.lower(F.trim("verb"))).where("confidence >= 0.4 and source <> target")
    return _counted(pairs=pairs, processed=answered, kept=ledger.latest(kept, ["source", "target", "verb"], ["confidence"]))


@_q("place_link_candidates", "gz AS (SELECT DISTINCT lower(word) AS term FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE regexp_full_match(word, '[a-z]{7,}'))", "SELECT DISTINCT doc_id AS id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) JOIN gz ON gz.term = w WHERE NOT (doc_id % 3 = 0 AND length(term) % 2 = 0)")
def place_link_candidates(a):
    """Texts that name a place, less those that are linked to it already."""
    terms = a.raw("benchmark").select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike("^[a-z]{7,}$")).select(F.col("word").alias("term")).distinct()
    named = places.mentions(a.raw("documents").select(F.col("doc_id").alias("id"), "text"), "text", terms)
    before = a.raw("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), "text")
    linked = places.mentions(before, "text", terms.where(F.length("term") % 2 == 0))  # the links that there are
    return named.join(linked, ["id", "term"], "left_anti")


@_q("known_files", PAGES, "SELECT page_id, sha256, 'known' AS action FROM files WHERE sha256 IN (SELECT sha256 FROM files WHERE known = 'ingested') AND coalesce(known, '') <> 'failed'")
def known_files(a):
    """K3: files that an ingest skips, by content."""
    hashes = a.pages.where("known = 'ingested'").select("sha256").distinct()
    return a.pages.where("coalesce(known, '') <> 'failed'").join(hashes, "sha256", "left_semi").select("page_id", "sha256", F.lit("known").alias("action"))
