"""Queries over the text world: search, vectors, retrieval, groups of pages, ingest, places."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions import exprs
from folioworks.operators import groups, ledger, nearest, places, text
from folioworks.plans.ctes import AUDIT, DOCS, PAGES, sql
from folioworks.plans.registry import query
from folioworks.sources import shared
from folioworks.sources.archive import Archive


def _q(name, *parts):
    def put(fn):
        query(name, sql(*parts) if parts else None)(lambda spark, folder: fn(Archive(spark, folder)))
        return fn

    return put


def _docs(a):
    return a.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"), "lang", "source")


def _index(a):
    return text.indexed(_docs(a), "description")


_WORDS = r"w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM documents), ix AS (SELECT id, len(l) AS length, ' ' || array_to_string(l, ' ') || ' ' AS t, l FROM w), co AS (SELECT count(*) AS n, avg(length) AS ml FROM ix)"
_BM25 = "round(greatest(ln((co.n - hh.h + 0.5) / (hh.h + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / co.ml)), 6)"


@_q("fts_tokens fts_tokens_all", _WORDS, "SELECT term, count(*) AS tf, count(DISTINCT id) AS docs FROM (SELECT id, unnest(l) AS term FROM w) GROUP BY 1")
def fts_tokens(a):
    """X1"""
    terms = _docs(a).select("id", F.explode(exprs.words(F.col("description"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("id").alias("docs"))


@_q("fts_prefix_bm25", _WORDS, "hits AS (SELECT id, length, CAST(len(list_filter(l, lambda x: starts_with(x, 'licen'))) AS BIGINT) AS tf FROM ix), hh AS (SELECT count(*) AS h FROM hits WHERE tf > 0)", f"SELECT id, tf, {_BM25} AS score FROM hits, co, hh WHERE tf > 0")
def fts_prefix_bm25(a):
    return text.prefix_search(_index(a), "w_description", text.escaped("Licen")[1][0])


@_q("fts_phrase", _WORDS, "hits AS (SELECT id, length, CAST((length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' licensed  under ', ''))) / 17 AS BIGINT) AS tf FROM ix), hh AS (SELECT count(*) AS h FROM hits WHERE tf > 0)", f"SELECT id, tf, {_BM25} AS score FROM hits, co, hh WHERE tf > 0")
def fts_phrase(a):
    return text.phrase_search(_index(a), "w_description", text.escaped('"Licensed under"')[1])


@_q("fts_snippet")
def fts_snippet(a):
    """X7"""
    return _docs(a).where(F.contains(F.lower("description"), F.lit("licensed"))).select("id", text.snippet(F.col("description"), "licensed").alias("snippet"))


@_q("keyword_with_entities", _WORDS, "hits AS (SELECT id, length, CAST(len(list_filter(l, lambda x: starts_with(x, 'mit'))) AS BIGINT) AS tf FROM ix), hh AS (SELECT count(*) AS h FROM hits WHERE tf > 0)", f", al AS (SELECT id, 1 AS p, {_BM25} AS score FROM hits, co, hh WHERE tf > 0 UNION ALL SELECT doc_id, 2, 0.5 FROM documents WHERE contains(source, 'src1')) SELECT id, arg_min(score, p) AS score FROM al GROUP BY 1")
def keyword_with_entities(a):
    """Full-text hits first, else records linked to a matching name with score 0.5."""
    hits = text.prefix_search(_index(a), "w_description", "mit").select("id", F.lit(1).alias("priority"), "score")
    named = _docs(a).where(F.contains("source", F.lit("src1"))).select("id", F.lit(2).alias("priority"), F.lit(0.5).alias("score"))
    return hits.unionByName(named).groupBy("id").agg(F.min_by("score", "priority").alias("score"))


@_q("browse_by_filters", DOCS, "SELECT id, title, date_depicted FROM docs WHERE is_trashed = 0 AND group_id IS NULL AND source_archive = '5-LOW' ORDER BY date_depicted DESC NULLS LAST, id DESC LIMIT 50")
def browse_by_filters(a):
    """O6, X9"""
    return a.standalone.where("source_archive = '5-LOW'").orderBy(F.desc_nulls_last("date_depicted"), F.desc("id")).limit(50).select("id", "title", "date_depicted")


_TOK = "tk AS (SELECT doc_id AS id, unnest(list_concat(regexp_extract_all(text, '[一-鿿㐀-䶿]'), list_transform(regexp_extract_all(text, '[a-zA-Z0-9À-ɏ]+'), lambda x: lower(x)))) AS token FROM documents)"
_EMB = """tf AS (SELECT id, token, count(*) AS tf FROM tk GROUP BY 1, 2), hx AS (SELECT id, tf, CAST('0x' || right(md5(token), 3) AS INT) AS v FROM tf),
 sl AS (SELECT id, v % 512 AS slot, sum(CASE WHEN (v >> 9) & 1 = 1 THEN 1 ELSE -1 END * (1 + ln(tf))) AS w FROM hx GROUP BY 1, 2), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM sl GROUP BY 1),
 em AS (SELECT sl.id, slot, w / CASE WHEN norm = 0 THEN 1 ELSE norm END AS weight FROM sl JOIN nm ON nm.id = sl.id)"""


@_q("token_frequencies token_frequencies_all", _TOK, "SELECT id, token, count(*) AS tf FROM tk GROUP BY 1, 2")
def token_frequencies(a):
    """A21"""
    return _docs(a).select("id", F.explode(exprs.tokens(F.col("description"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


@_q("hashed_embedding", _TOK, _EMB, "SELECT id, count(*) AS slots, round(sum(abs(weight)), 5) AS l1, round(max(weight), 5) AS top FROM em GROUP BY 1")
def hashed_embedding(a):
    """F7, A22"""
    e = text.embedding(_docs(a), "description")
    return e.groupBy("id").agg(F.count("*").alias("slots"), F.round(F.sum(F.abs("weight")), 5).alias("l1"), F.round(F.max("weight"), 5).alias("top"))


@_q("semantic_topk", _TOK, _EMB, """SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
 (SELECT q.id AS query_id, e.id, round(sum(e.weight * q.weight), 6) AS score FROM em e JOIN em q ON q.slot = e.slot WHERE q.id % 100 = 0 GROUP BY 1, 2)) WHERE rank <= 5""")
def semantic_topk(a):
    """V1: every hundredth document as a query against all."""
    e = shared.staged(text.vectors(_docs(a), "description"), "vectors")
    return text.similar(e, e.where("id % 100 = 0"), 5).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@_q("dense_cosine_topk", """, q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, q)) WHERE rank <= 5""".replace(", q AS", "WITH q AS", 1))
def dense_cosine_topk(a):
    """F8: a stated query set, every hundredth vector, against all vectors."""
    v = a.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return nearest.dense(v, asked, 5).select("query_id", F.col("id").alias("vec_id"), "rank")


_RAG = "qs AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') AS p FROM benchmark), hit AS (SELECT item_id AS question_id, id, CAST((length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' ' || replace(p, ' ', '  ') || ' ', ''))) / (length(replace(p, ' ', '  ')) + 2) AS BIGINT) AS tf FROM ix JOIN qs ON contains(t, ' ' || p || ' '))"


def _retrieved(a):
    asked = a.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return text.phrases_by_question(_index(a), "w_description", asked)


@_q("rag_retrieval_top15", _WORDS, _RAG, "SELECT question_id, id, tf, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY tf DESC, id) AS rank FROM hit) WHERE rank <= 15")
def rag_retrieval_top15(a):
    """Each question as one phrase."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("tf"), "id"))
    return _retrieved(a).withColumn("rank", rank).where("rank <= 15")


@_q("rag_retrieval_or_similar")
def rag_retrieval_or_similar(a):
    """As rag_retrieval_top15, but questions without a hit get the most similar documents."""
    asked = a.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return text.retrieved(_docs(a), "description", asked)


@_q("rag_context", _WORDS, _RAG, "SELECT question_id, string_agg('[Doc #' || id || '] ' || lang || ' ' || coalesce(substring(text, 1, 200), 'Unknown'), chr(10) ORDER BY id) AS context FROM hit JOIN documents ON doc_id = id GROUP BY 1")
def rag_context(a):
    """J22, F18, F22"""
    block = F.concat(F.lit("[Doc #"), "id", F.lit("] "), "lang", F.lit(" "), F.coalesce(F.substring("description", 1, 200), F.lit("Unknown")))
    hits = _retrieved(a).join(_docs(a), "id").select("question_id", "id", block.alias("block"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "block"))), lambda x: x["block"])
    return hits.groupBy("question_id").agg(F.array_join(lines, "\n").alias("context"))


_ANSWERS = "SELECT conv_id, turn, 'As [Doc #' || conv_id || '] says' || CASE turn % 4 WHEN 0 THEN ' and [Doc #' || (conv_id + 1) || '], [Doc #' || (conv_id + 2) || ']' WHEN 1 THEN ' (see [Doc #' || conv_id || '])' ELSE '' END AS answer FROM conversations WHERE turn % 4 < 2 UNION ALL SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 'The documents do not contain this.' ELSE 'Perhaps.' END FROM conversations WHERE turn % 4 >= 2"


def _answers(a):
    c = a.raw("conversations")
    cite = [F.concat(F.lit("[Doc #"), F.col("conv_id") + i, F.lit("]")) for i in range(3)]
    four = F.col("turn") % 4
    body = F.when(four == 0, F.concat(F.lit("As "), cite[0], F.lit(" says and "), cite[1], F.lit(", "), cite[2])).when(four == 1, F.concat(F.lit("As "), cite[0], F.lit(" says (see "), cite[0], F.lit(")")))
    return c.select("conv_id", "turn", body.otherwise(F.when(four == 2, "The documents do not contain this.").otherwise("Perhaps.")).alias("answer"))


@_q("rag_citations", f"an AS ({_ANSWERS})", "SELECT conv_id, turn, unnest(list_distinct(list_transform(regexp_extract_all(answer, '\\[Doc #(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)))) AS cited FROM an")
def rag_citations(a):
    """F21"""
    return _answers(a).select("conv_id", "turn", F.explode(exprs.citations(F.col("answer"))).alias("cited"))


@_q("rag_confidence", "SELECT CASE turn % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'none' ELSE 'low' END AS confidence, count(*) AS answers FROM conversations GROUP BY 1")
def rag_confidence(a):
    """A30"""
    return _answers(a).groupBy(exprs.confidence(F.col("answer")).alias("confidence")).agg(F.count("*").alias("answers"))


def _pages(a):
    c = a.raw("conversations")
    return groups.numbered(c.select(F.col("conv_id").alias("group_id"), "turn", F.col("turn").alias("page_id"), "role", "text"), "group_id", "turn")


_PG = "pg AS (SELECT conv_id AS group_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations)"


@_q("group_merge_transcription", _PG, "SELECT group_id, string_agg(CASE WHEN contains(text, '[Page ') THEN text ELSE '[Page ' || page || ']' || chr(10) || text END, chr(10) || chr(10) ORDER BY page) AS transcription, count(*) AS pages FROM pg WHERE trim(text) <> '' GROUP BY 1")
def group_merge_transcription(a):
    return groups.transcription(_pages(a))


@_q("group_merge_fields", _PG, "SELECT f.group_id, f.text, m.role FROM (SELECT group_id, arg_min(text, page) AS text FROM pg WHERE trim(text) <> '' GROUP BY 1) f JOIN (SELECT group_id, arg_max(role, n * 1000 - first) AS role FROM (SELECT group_id, role, count(*) AS n, min(page) AS first FROM pg GROUP BY 1, 2) GROUP BY 1) m USING (group_id)")
def group_merge_fields(a):
    """A17"""
    p = _pages(a)
    return groups.first_filled(p, "text").join(groups.most_common(p, "role"), "group_id").select("group_id", "text", "role")


@_q("page_reorder", _PG, "SELECT group_id, turn AS page_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY turn DESC) AS INT) AS page FROM pg")
def page_reorder(a):
    """Every group's pages in reverse."""
    p = _pages(a)
    order = p.groupBy("group_id").agg(F.reverse(F.array_sort(F.collect_list("page_id"))).alias("ids"))
    return groups.reordered(p, order)


@_q("group_entity_dedup", _PG, "SELECT group_id, CAST(length(text) % 5 AS BIGINT) AS entity_id, role, arg_min(substring(text, 1, 20), page) AS context FROM pg GROUP BY 1, 2, 3")
def group_entity_dedup(a):
    """A19, W7"""
    links = _pages(a).select("group_id", (F.length("text") % 5).cast("long").alias("entity_id"), "role", F.substring("text", 1, 20).alias("context"), "page")
    return groups.distinct_links(links)


@_q("embed_text", "SELECT doc_id AS id, concat_ws(' ', nullif(lang, ''), nullif(text, ''), nullif(source, 'src0')) AS embed FROM documents")
def embed_text(a):
    """F17"""
    return _docs(a).select("id", exprs.embed_text(F.col("lang"), F.col("description"), F.nullif(F.col("source"), F.lit("src0"))).alias("embed"))


@_q("truncated_descriptions", "SELECT doc_id AS id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || '… [truncated, original length ' || length(text) || ']' ELSE text END AS description FROM documents")
def truncated_descriptions(a):
    """F19"""
    return _docs(a).select("id", exprs.audit_value("description", F.col("description")).alias("description"))


@_q("place_split", "SELECT n_nationkey AS id, unnest([n_name || ' City', r_name]) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def place_split(a):
    """F20"""
    n = a.raw("nation").join(a.raw("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    where = F.concat(F.lit("near "), "n_name", F.lit(" City, MA ("), "n_name", F.lit(" University); "), "r_name", F.lit(" region and USA"))
    return n.select(F.col("n_nationkey").alias("id"), F.explode(exprs.places(where)).alias("place"))


@_q("gazetteer_counts", "SELECT lower(n_name) AS norm, min(n_name) AS display, count(*) AS records FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) >= 2")
def gazetteer_counts(a):
    """A20"""
    return places.gazetteer(a.raw("customer").join(a.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("location")))


_GAZ = "gz AS (SELECT DISTINCT lower(word) AS term FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE regexp_full_match(word, '[a-z]{9,}'))"


@_q("gazetteer_mentions", _GAZ, "SELECT term, count(DISTINCT doc_id) AS records FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) JOIN gz ON gz.term = w GROUP BY 1")
def gazetteer_mentions(a):
    """Texts that name a place, by joins on words."""
    terms = a.raw("benchmark").select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike("^[a-z]{9,}$")).select(F.lower("word").alias("term")).distinct()
    return places.mentions(_docs(a), "description", terms).groupBy("term").agg(F.countDistinct("id").alias("records"))


@_q("reclassify_candidates", "SELECT DISTINCT c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND c_acctbal < 0")
def reclassify_candidates(a):
    """U7, U8"""
    n = a.raw("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    c = a.raw("customer")
    return c.join(n, "c_nationkey", "left_semi").join(c.where("c_acctbal >= 0").select("c_custkey"), "c_custkey", "left_anti").select(F.col("c_name").alias("name")).distinct()


@_q("ingest_pending_antijoin", PAGES, "SELECT page_id, sha256, CASE known WHEN 'failed' THEN 'requeue' ELSE 'new' END AS action FROM files WHERE (known IS NULL OR known = 'failed') AND sha256 NOT IN (SELECT sha256 FROM files WHERE known = 'ingested')")
def ingest_pending_antijoin(a):
    return ledger.pending(a.pages)


@_q("asset_catalog", "SELECT page_id, coalesce(lower(nullif(regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1), '')), '') AS suffix FROM pages")
def asset_catalog(a):
    """S1, F27"""
    return a.raw("pages").select("page_id", exprs.suffix(F.col("url")).alias("suffix"))


@_q("run_status_histogram", AUDIT, "SELECT run_id, status, count(*) AS files FROM audit GROUP BY 1, 2")
def run_status_histogram(a):
    return ledger.histogram(a.audit)


@_q("ingest_run_summary", AUDIT, "SELECT run_id, count(*) AS total, count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status = 'err') AS errors, count(*) FILTER (status = 'requeued') AS requeued, CAST(round_even(count(*) FILTER (status = 'ok') / count(*) * 100, 0) AS BIGINT) AS percent FROM audit GROUP BY 1")
def ingest_run_summary(a):
    return ledger.summary(a.audit)


@_q("running_progress", AUDIT, "SELECT event_id, count(*) OVER w AS done, count(*) FILTER (status = 'ok') OVER w AS good FROM audit WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_progress(a):
    return ledger.progress(a.audit).select("event_id", "done", "good")


@_q("audit_history", AUDIT, "SELECT event_id, run_id, action FROM audit WHERE entity_id = 7 ORDER BY event_id DESC LIMIT 1000")
def audit_history(a):
    return ledger.history(a.audit, entity_id=7).select("event_id", "run_id", "action")


@_q("run_files_latest_wins", AUDIT, "SELECT run_id, entity_id, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM audit GROUP BY 1, 2")
def run_files_latest_wins(a):
    """M5"""
    return ledger.latest(a.audit.select("run_id", "entity_id", "event_id", "status"), ["run_id", "entity_id"], ["event_id"]).select("run_id", "entity_id", "status", "event_id")


@_q("run_files_titles", AUDIT, DOCS, "SELECT event_id, run_id, status, title FROM audit LEFT JOIN docs ON docs.id = event_id WHERE status = 'err'")
def run_files_titles(a):
    """J10, P15"""
    return a.audit.where("status = 'err'").join(a.documents.select(F.col("id").alias("event_id"), "title"), "event_id", "left").select("event_id", "run_id", "status", "title")


@_q("run_groups", AUDIT, DOCS, "SELECT run_id, group_id, count(DISTINCT docs.id) AS documents, count(DISTINCT event_id) AS files FROM audit JOIN docs ON docs.id = event_id WHERE status = 'ok' AND group_id IS NOT NULL GROUP BY 1, 2")
def run_groups(a):
    """J11, A15"""
    pages = a.documents.where("group_id is not null").select("id", "group_id")
    return a.audit.where("status = 'ok'").join(pages, F.col("id") == F.col("event_id")).groupBy("run_id", "group_id").agg(F.countDistinct("id").alias("documents"), F.countDistinct("event_id").alias("files"))


@_q("run_lifecycle", AUDIT, "SELECT run_id, CASE WHEN arg_max(status, event_id) = 'err' THEN 'crashed' ELSE 'done' END AS state, min(ts) AS started FROM audit GROUP BY 1")
def run_lifecycle(a):
    """M28"""
    return a.audit.groupBy("run_id").agg(F.when(F.max_by("status", "event_id") == "err", "crashed").otherwise("done").alias("state"), F.min("ts").alias("started"))


@_q("json_decode_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode_props(a):
    """S5"""
    return a.raw("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@_q("json_array_decode", "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def json_array_decode(a):
    """Vectors through their JSON text."""
    v = F.from_json(F.to_json(F.transform("embedding", lambda x: x.cast("double"))), "array<double>")
    return a.raw("embeddings").select("vec_id", F.size(v).cast("long").alias("dims"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


PAYLOAD = T.StructType([T.StructField("title", T.StringType()), T.StructField("entities", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])))])


@_q("payload_explode", "SELECT conv_id, turn, unnest(['A' || conv_id, 'B' || turn]) AS name, unnest(['person', 'place']) AS type FROM conversations")
def payload_explode(a):
    """Extraction payloads, some in code fences."""
    body = F.format_string('{"title": "t", "entities": [{"name": "A%d", "type": "person"}, {"name": "B%d", "type": "place"}]}', "conv_id", "turn")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    bare = F.regexp_replace(raw, r"^\s*```[a-z]*\s*|\s*```\s*$", "")
    c = a.raw("conversations").select("conv_id", "turn", F.from_json(bare, PAYLOAD).alias("p"))
    return c.select("conv_id", "turn", F.explode("p.entities").alias("e")).select("conv_id", "turn", "e.name", "e.type")


@_q("json_records", "SELECT count(*) AS n FROM benchmark")
def json_records(a):
    """S10"""
    return a.raw("benchmark").select(F.to_json(F.struct("*")).alias("j")).where(F.col("j").isNotNull()).agg(F.count("*").alias("n"))


@_q("document_reingest", PAGES, "SELECT page_id, coalesce(known, 'new') AS state, CASE WHEN known = 'failed' THEN 'kept' END AS annotation FROM files")
def document_reingest(a):
    """M7: re-extracted rows keep what users added."""
    kept = a.pages.where("known = 'failed'").select("page_id", F.lit("kept").alias("annotation"))
    return a.pages.join(kept, "page_id", "left").select("page_id", F.coalesce("known", F.lit("new")).alias("state"), "annotation")


@_q("insert_or_ignore_links", _PG, "SELECT group_id, role, count(*) AS n FROM (SELECT DISTINCT group_id, page, role FROM pg UNION ALL SELECT group_id, page, NULL FROM pg WHERE page = 1) GROUP BY 1, 2")
def insert_or_ignore_links(a):
    """M4"""
    links = _pages(a).select(F.col("group_id").alias("group_id"), "page", "role")
    new = links.union(links.where("page = 1").withColumn("role", F.lit(None).cast("string")))
    return ledger.insert_or_ignore(links, new, ["group_id", "page", "role"], "role").groupBy("group_id", "role").agg(F.count("*").alias("n"))


@_q("tag_get_or_create", "SELECT lower(name) AS name, count(*) AS n FROM (SELECT DISTINCT lower(p_type) AS name FROM part UNION SELECT DISTINCT lower(p_brand) FROM part) GROUP BY 1")
def tag_get_or_create(a):
    """M3: names that differ in case alone are one tag."""
    p = a.raw("part")
    old = p.select(exprs.ascii_lower(F.col("p_type")).alias("name")).distinct()
    offered = p.select(exprs.ascii_lower(F.col("p_brand")).alias("name")).union(p.select(exprs.ascii_lower(F.upper("p_type"))))
    return ledger.insert_or_ignore(old, offered, ["name"]).groupBy("name").agg(F.count("*").alias("n"))
