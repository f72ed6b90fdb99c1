"""Queries of deep pages, merged rows, wiped and re-extracted records, contexts of questions, and tools' texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import answers, extraction, groups, ledger, network, pages, places, postings, records
from folioworks.plans import library
from folioworks.plans.ctes import DESCRIBED, DOC_ENTS, DOCS, ENTITIES, GROUP_TXNS, GROUPS, LIVE, TAGS, TXNS, sql
from folioworks.plans.registry import query
from folioworks.sources.archive import Archive


def _q(name, *parts):
    def put(fn):
        query(name, sql(*parts))(lambda spark, folder: fn(Archive(spark, folder)))
        return fn

    return put


@_q("transactions_deep_page", DOCS, TXNS, "SELECT document_id, lot_number, price FROM txns ORDER BY price DESC, document_id, lot_number LIMIT 200 OFFSET 5600")
def transactions_deep_page(a):
    """The 29th page of 200, of which only the range is sorted that it lies in."""
    order = [F.desc("price"), F.asc("document_id"), F.asc("lot_number")]
    return pages.page(a.transactions.select("document_id", "lot_number", "price"), order, 29, 200, early=0)


@_q("run_files_deep_page", "SELECT event_id, event_type FROM events ORDER BY event_type, event_id LIMIT 90 OFFSET 810")
def run_files_deep_page(a):
    """Files of all runs by name, a page of up to 2000."""
    return pages.page(a.audit.select("event_id", F.col("action").alias("event_type")), [F.asc("event_type"), F.asc("event_id")], 10, 90, 2000, early=0)


_STAMPED = f"""st AS (SELECT d.*, strftime(o_orderdate, '%Y-%m-%d') AS created_at, CASE id % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY * (id % 90), '%Y-%m-%d') WHEN 1 THEN '' END AS updated_at FROM ddocs d JOIN orders ON o_orderkey = id),
 al AS (SELECT 'document' AS record_type, id, title, created_at, updated_at FROM st WHERE is_trashed = 0 AND group_id IS NULL UNION ALL SELECT 'group', g.id, g.title, c, u FROM grps g JOIN (SELECT group_id, min(created_at) AS c, max(updated_at) AS u FROM st WHERE group_id IS NOT NULL GROUP BY 1) x ON x.group_id = g.id WHERE g.is_trashed = 0)"""


def _gallery(key: str, direction: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT record_type, id, title, created_at, updated_at FROM al WHERE record_type = '{kind}' ORDER BY nullif({key}, '') {direction} NULLS LAST, id LIMIT 40 OFFSET 40)" for kind in ("document", "group"))


@_q("gallery_by_updated", DOCS, GROUPS, DESCRIBED, _STAMPED, _gallery("coalesce(nullif(updated_at, ''), created_at)", "DESC"))
def gallery_by_updated(a):
    """By the time of the last change, or else of making."""
    return records.gallery_page(a, 2, 40, "updated", True).select("record_type", "id", "title", "created_at", "updated_at")


@_q("gallery_by_created", DOCS, GROUPS, DESCRIBED, _STAMPED, _gallery("created_at", "ASC"))
def gallery_by_created(a):
    """O13"""
    return records.gallery_page(a, 2, 40, "created").select("record_type", "id", "title", "created_at", "updated_at")


@_q("group_merge_transactions", DOCS, TXNS, "SELECT group_id, page_number AS page, seller, buyer, date, price, lot_number FROM docs JOIN txns ON document_id = id WHERE group_id IS NOT NULL")
def group_merge_transactions(a):
    """The transactions of the groups' pages as rows of the groups."""
    mine = a.documents.where("group_id is not null").select("group_id", F.col("page_number").cast("long").alias("page"), F.col("id").alias("document_id"))
    return groups.merged_transactions(mine, a.transactions).select("group_id", "page", "seller", "buyer", "date", "price", "lot_number")


@_q("group_merge_tags", DOCS, TAGS, "SELECT DISTINCT group_id, tag FROM docs JOIN dtags ON document_id = id WHERE group_id IS NOT NULL")
def group_merge_tags(a):
    """A19"""
    mine = a.documents.where("group_id is not null").select("group_id", F.col("id").alias("document_id"))
    return groups.merged_tags(mine, a.document_tags)


_PLACES = "(SELECT unnest(['letter', 'telegram', 'memo', 'transaction record', 'financial statement', 'inventory', 'artifact photograph', 'other']) AS category, unnest(range(8)) AS p)"


@_q("mediums_with_groups", DOCS, GROUPS, DESCRIBED, f"""gm AS (SELECT arg_min(medium_category, page_number) AS medium_category FROM ddocs WHERE trim(coalesce(medium, '')) <> '' AND group_id IN (SELECT id FROM grps WHERE is_trashed = 0) GROUP BY group_id)
 SELECT category, CAST(p AS INT) AS place, count(*) AS records FROM {_PLACES} JOIN (SELECT medium_category FROM ddocs WHERE is_trashed = 0 AND group_id IS NULL UNION ALL SELECT medium_category FROM gm) ON medium_category = category GROUP BY 1, 2""".replace("gm AS", ", gm AS", 1))
def mediums_with_groups(a):
    """Categories of live records and of groups, these by their first page that names a medium, in the taxonomy's order."""
    paged = a.described.where("group_id is not null").withColumn("page", F.col("page_number"))
    first = groups.first_filled(paged, "medium").join(a.live_groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    both = records.listed(a.described).select("medium_category").unionByName(first.select(exprs.medium_category(F.col("medium")).alias("medium_category")))
    place = F.array_position(F.array(*map(F.lit, exprs.MEDIUM_CATEGORIES)), F.col("category")) - 1
    counted = both.groupBy(F.col("medium_category").alias("category")).agg(F.count("*").alias("records"))
    return counted.select("category", place.cast("int").alias("place"), "records").where("place >= 0")


@_q("audit_values_json", TXNS, "SELECT document_id, '{\"seller\":' || coalesce('\"' || seller || '\"', 'null') || ',\"tags\":[\"a\",' || (document_id % 3) || ']}' AS nested, CAST(document_id AS VARCHAR) AS number, CASE WHEN document_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, seller AS string FROM txns")
def audit_values_json(a):
    """values that aren't strings are JSON, NULL inside them too; a NULL stays."""
    t = a.transactions
    third = F.concat(F.lit('{"seller":'), F.coalesce(F.to_json(F.array("seller"), {"ignoreNullFields": "false"}), F.lit("[null]")))
    bare = F.concat(F.regexp_replace(third, r"\[(.*)\]$", "$1"), F.lit(',"tags":["a",'), (F.col("document_id") % 3).cast("string"), F.lit("]}"))
    value = F.from_json(bare, "seller string, tags array<string>")
    nested = F.to_json(F.struct(value["seller"].alias("seller"), F.array(F.lit("a"), (F.col("document_id") % 3).cast("string")).alias("tags")), {"ignoreNullFields": "false"})
    return t.select("document_id", F.regexp_replace(nested, r'"(\d)"\]', "$1]").alias("nested"), exprs.audit_json("x", F.col("document_id"), "bigint").alias("number"), exprs.audit_json("x", F.col("document_id") % 2 == 0, "boolean").alias("flag"), exprs.audit_json("x", F.col("seller"), "string").alias("string"))


_TERMS = r"bw AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), tm AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS term FROM bw, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)"


def _terms(a):
    w = exprs.words(F.col("text"))
    each = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.when(F.size(w) >= n, F.array_join(F.slice(w, F.lit(1), n), " ")))
    return a.raw("benchmark").select(F.explode(each).alias("term")).where("term is not null").distinct()


@_q("place_mentions_of_words", _TERMS, r"dw AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)", "SELECT id, term FROM dw JOIN tm ON contains(t, ' ' || term || ' ')")
def place_mentions_of_words(a):
    """Terms of one, two and three words in all texts."""
    return places.mentions(a.raw("documents").select(F.col("doc_id").alias("id"), "text"), "text", _terms(a))


@_q("wipe_metadata_whole", DOCS, DESCRIBED, "SELECT id, CASE WHEN id % 7 = 0 THEN filename ELSE title END AS title, CASE WHEN id % 7 <> 0 THEN date_depicted END AS date_depicted, CASE WHEN id % 7 <> 0 THEN date_range_start END AS date_range_start, CASE WHEN id % 7 <> 0 THEN medium END AS medium, CASE WHEN id % 7 = 0 THEN 'Extraction failed: metadata wiped' ELSE 'About ' || title END AS description, CASE WHEN id % 7 = 0 THEN 0 ELSE is_key_evidence END AS is_key_evidence, source_archive FROM ddocs")
def wipe_metadata_whole(a):
    """Every field; other rows stay as they are."""
    docs = a.described.withColumn("description", F.concat(F.lit("About "), "title"))
    return ledger.wiped(docs, F.col("id") % 7 == 0).select("id", "title", "date_depicted", "date_range_start", "medium", "description", "is_key_evidence", "source_archive")


@_q("reextraction_in_place", DOCS, DESCRIBED, """SELECT id, CASE WHEN id % 7 = 0 THEN 'Deed ' || id ELSE title END AS title, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 1 THEN '1900-01-01' END ELSE date_depicted END AS date_depicted, CASE WHEN id % 7 = 0 THEN 'Old telegram' ELSE medium END AS medium,
 CASE WHEN id % 7 = 0 THEN 'telegram' ELSE medium_category END AS medium_category, CASE WHEN id % 5 = 0 THEN 'mine' END AS annotation, is_key_evidence, CASE WHEN id % 3 <> 0 THEN source_archive WHEN id % 7 = 0 THEN 'Box 7' END AS source_archive, CASE WHEN id % 7 = 0 THEN 'now' ELSE 'before' END AS updated_at FROM ddocs""")
def reextraction_in_place(a):
    """M7: a seventh of the records extracted again, from payloads as an extractor gives them."""
    docs = a.described.withColumns({"sha256": F.sha2("filename", 256), "annotation": F.when(F.col("id") % 5 == 0, "mine"), "source_archive": F.when(F.col("id") % 3 != 0, F.col("source_archive")), "updated_at": F.lit("before")})
    date = F.when(F.col("id") % 2 == 0, "Date unknown").otherwise("1900-01-01")
    payload = F.to_json(F.struct(F.concat(F.lit("Deed "), "id").alias("title"), date.alias("date_depicted"), F.lit("Old telegram").alias("medium"), F.lit("letters").alias("medium_category")))
    raw = docs.where("id % 7 = 0").select("sha256", F.concat(F.lit("```json\n"), payload, F.lit("\n```")).alias("raw_extraction"))
    fresh = extraction.decoded(raw).select("sha256", "title", "date_depicted", "medium", "medium_category")
    return extraction.reextracted(docs, fresh, F.lit("Box 7"), F.lit("now")).select("id", "title", "date_depicted", "medium", "medium_category", "annotation", "is_key_evidence", "source_archive", "updated_at")


_HITS = """qh AS (SELECT custkey AS question_id, 'document' AS kind, id, row_number() OVER (PARTITION BY custkey ORDER BY id) AS rank FROM live UNION ALL SELECT g.id, 'group', g.id, 1 FROM lgrps g),
 qr AS (SELECT 'document' AS kind, id, title, coalesce(date_depicted, date_range_start) AS date, source_archive AS location, 'About ' || title AS description, CASE WHEN id % 9 = 0 THEN 'seen' END AS annotation FROM docs UNION ALL SELECT 'group', id, title, date_depicted, source_archive, NULL, '' FROM grps),
 qt AS (SELECT 'document' AS kind, document_id AS id, seller, buyer, date, price, currency, auction_house, lot_number FROM txns UNION ALL SELECT 'group', group_id, seller, buyer, date, price, currency, auction_house, lot_number FROM gtxns)"""
_BLOCKS = """bl AS (SELECT question_id, string_agg('[Doc #' || id || '] ' || CASE WHEN kind = 'group' THEN '(multi-page group) ' ELSE '' END || title || chr(10) || 'Date: ' || coalesce(nullif(date, ''), 'Unknown') || chr(10) || 'Location: ' || coalesce(nullif(location, ''), 'Unknown') || chr(10) || 'Description: ' || coalesce(description, '') || coalesce(chr(10) || 'Researcher note: ' || nullif(annotation, ''), ''), chr(10) || chr(10) ORDER BY kind, rank) AS records
  FROM qh JOIN qr USING (kind, id) GROUP BY 1),
 li AS (SELECT question_id, kind, date, '[Doc #' || id || ']' || coalesce(' | Date: ' || nullif(date, ''), '') || coalesce(' | Seller: ' || seller, '') || coalesce(' | Buyer: ' || buyer, '') || ' | Price: ' || CAST(price AS VARCHAR) || ' ' || currency || coalesce(' | Auction: ' || auction_house || ' lot ' || lot_number, '') AS said FROM qh JOIN qt USING (kind, id)),
 tx AS (SELECT question_id, string_agg(said, chr(10) ORDER BY kind, date NULLS FIRST, encode(said)) AS transactions FROM li GROUP BY 1)"""


@_q("question_contexts", DOCS, GROUPS, LIVE, TXNS, GROUP_TXNS, _HITS, _BLOCKS, "SELECT question_id, records, coalesce(transactions, 'No transactions recorded.') AS transactions FROM bl LEFT JOIN tx USING (question_id)")
def question_contexts(a):
    """A question for each customer: the blocks of their records and groups, and the lines of these records' transactions."""
    rank = F.row_number().over(Window.partitionBy("custkey").orderBy("id"))
    hits = a.standalone.select(F.col("custkey").alias("question_id"), F.lit("document").alias("kind"), "id", rank.alias("rank")).unionByName(a.live_groups.select(F.col("id").alias("question_id"), F.lit("group").alias("kind"), "id", F.lit(1).alias("rank")))
    docs = a.documents.select(F.lit("document").alias("kind"), "id", "title", records.dated().alias("date"), F.col("source_archive").alias("location"), F.concat(F.lit("About "), "title").alias("description"), F.when(F.col("id") % 9 == 0, "seen").alias("annotation"))
    grps = a.groups.select(F.lit("group").alias("kind"), "id", "title", F.col("date_depicted").alias("date"), F.col("source_archive").alias("location"), F.lit(None).cast("string").alias("description"), F.lit("").alias("annotation"))
    columns = ["seller", "buyer", "date", F.col("price").cast("string").alias("price"), "currency", "auction_house", "lot_number", F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("notes")]
    lines = a.transactions.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), *columns).unionByName(a.group_transactions.select(F.lit("group").alias("kind"), F.col("group_id").alias("id"), *columns))
    return answers.contexts(hits, docs.unionByName(grps), lines)


_SEARCHED = r"""sw AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS length, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: starts_with(x, 'licen'))) AS tf, lang FROM documents),
 sx AS (SELECT id, lang, round(greatest(ln((n - h + 0.5) / (h + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ml)), 6) AS score FROM sw, (SELECT count(*) AS n, count(*) FILTER (tf > 0) AS h, avg(length) AS ml FROM sw) WHERE tf > 0),
 sr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM sx)"""


@_q("tool_search_text", _SEARCHED, "SELECT 'Found ' || count(*) || ' document(s) matching ''licen'':' || chr(10) || chr(10) || string_agg(CASE WHEN place <= 20 THEN '• [Doc #' || id || '] In ' || lang || ' (date unknown)' END, chr(10) ORDER BY place) AS text FROM sr")
def tool_search_text(a):
    """A search as a tool gives it."""
    docs = a.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.concat(F.lit("In "), "lang").alias("title"))
    scored = postings.scored(postings.prefix(postings.build(docs, ("description",)), "licen"), postings.lengths(docs, ("description",)))
    first = scored.orderBy(F.desc("score"), "id").limit(50)  # no more is named
    named = first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "place")
    found = scored.join(named, "id", "left").join(docs.select("id", "title"), "id").withColumns({"date": F.lit(None).cast("string"), "snippet": F.lit("")})
    return answers.found_text(found, "licen")


@_q("tool_answer_text", f"an AS ({library._ANSWERS})", "SELECT conv_id, turn, answer || chr(10) || chr(10) || '**Confidence:** ' || CASE turn % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'none' ELSE 'low' END || chr(10) || '**Source documents:** ' || CASE turn % 4 WHEN 0 THEN '#' || conv_id || ', #' || (conv_id + 1) || ', #' || (conv_id + 2) WHEN 1 THEN '#' || conv_id ELSE '' END AS text FROM an")
def tool_answer_text(a):
    """An answer as a tool gives it."""
    said = library._answers(a)
    return said.select("conv_id", "turn", answers.answer_text(F.col("answer"), exprs.confidence(F.col("answer")), exprs.citations(F.col("answer"))).alias("text"))


@_q("tool_entity_sheets", ENTITIES, DOCS, DOC_ENTS, """ap AS (SELECT entity_id, document_id, title, date_depicted AS date, role, row_number() OVER (PARTITION BY entity_id ORDER BY date_depicted NULLS LAST, document_id, role) AS pl FROM dents JOIN docs ON docs.id = document_id WHERE entity_id < 2000000),
 dl AS (SELECT entity_id AS id, count(*) AS n, string_agg('  • [Doc #' || document_id || '] ' || title || ' (' || coalesce(date, '?') || ') — ' || role, chr(10) ORDER BY pl) AS lines FROM ap WHERE pl <= 30 GROUP BY 1),
 cc AS (SELECT a.entity_id, b.entity_id AS other, count(*) AS shared FROM dents a JOIN dents b ON a.document_id = b.document_id AND a.entity_id <> b.entity_id WHERE a.entity_id < 2000000 AND b.entity_id < 2000000 GROUP BY 1, 2),
 cr AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY shared DESC, other) AS place FROM cc),
 cl AS (SELECT entity_id AS id, string_agg('  • ' || name || ' (' || type || ') — ' || shared || ' document(s)', chr(10) ORDER BY place) AS lines FROM cr JOIN ents ON ents.id = other WHERE place <= 10 GROUP BY 1)
 SELECT e.id, '# Entity: ' || name || ' (' || upper(type[1]) || type[2:] || ')' || chr(10) || '**Documents:** ' || coalesce(n, 0) || chr(10) || chr(10) || '**Document Appearances:**' || coalesce(chr(10) || dl.lines, '') || coalesce(chr(10) || chr(10) || '**Frequently Co-occurs With:**' || chr(10) || cl.lines, '') AS text
 FROM ents e LEFT JOIN dl ON dl.id = e.id LEFT JOIN cl ON cl.id = e.id WHERE e.id < 2000000""".replace("ap AS", ", ap AS", 1))
def tool_entity_sheets(a):
    """Every seller's sheet as a tool gives it; companions among sellers."""
    sellers = a.document_entities.where("entity_id < 2000000")
    seen = sellers.join(a.documents.select(F.col("id").alias("document_id"), "title", F.col("date_depicted").alias("date")), "document_id")
    pairs = network.paired(sellers.select(F.lit("d").alias("kind"), F.col("document_id").alias("record_id"), "entity_id", "role")).groupBy("source", "target").agg(F.sum("n").alias("shared"))
    both = pairs.select(F.col("source").alias("entity_id"), F.col("target").alias("other"), "shared").unionByName(pairs.select(F.col("target").alias("entity_id"), F.col("source").alias("other"), "shared"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("shared"), "other"))
    top = both.withColumn("place", place).where(F.col("place") <= 10).join(a.entities.select(F.col("id").alias("other"), "name", "type"), "other")
    return answers.entity_text(a.entities.where("id < 2000000").select("id", "name", "type"), seen, top)


_ALIASES = """ba AS (SELECT id AS entity_id, 'Acct ' || id AS alias, 'acct ' || id AS normalized FROM ents WHERE type IN ('person', 'institution')),
 ad AS (SELECT id AS entity_id, 'Old ' || name AS alias, 'old ' || lower(name) AS normalized FROM ents WHERE type IN ('person', 'institution') AND id % 5 = 0)"""


@_q("alias_edits", ENTITIES, _ALIASES, "SELECT * FROM ba WHERE entity_id % 7 <> 0 UNION ALL SELECT * FROM ad")
def alias_edits(a):
    """Aliases of all people and institutions: some that are there already, under other spellings, and some new ones are added, some removed."""
    people = a.entities.where(F.col("type").isin("person", "institution")).select(F.col("id").alias("entity_id"), "name")
    named = lambda rows, alias: rows.select("entity_id", alias.alias("alias")).withColumn("normalized", exprs.normalized_name(F.col("alias")))
    base = named(people, F.concat(F.lit("Acct "), "entity_id"))
    again = named(people.where("entity_id % 3 = 0"), F.concat(F.lit(" ACCT   "), "entity_id"))
    new = named(people.where("entity_id % 5 = 0"), F.concat(F.lit("Old "), "name"))
    added = ledger.insert_or_ignore(base, again.unionByName(new), ["entity_id", "normalized"])
    gone = base.where("entity_id % 7 = 0").select("entity_id", "normalized")
    return added.join(gone, ["entity_id", "normalized"], "left_anti").select("entity_id", "alias", "normalized")
