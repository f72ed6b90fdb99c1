"""Queries over the positional index of several columns, and retrieval with its fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import postings, text
from folioworks.plans.ctes import sql
from folioworks.plans.library import _EMB, _RAG, _TOK, _WORDS
from folioworks.plans.registry import query
from folioworks.sources import shared
from folioworks.sources.archive import Archive


def _q(name, *parts):
    def put(fn):
        query(name, sql(*parts))(lambda spark, folder: fn(Archive(spark, folder)))
        return fn

    return put


def _world(a):
    """The text world's documents with four indexed columns, some in the trash and some pages of groups."""
    d = F.col("doc_id")
    return a.raw("documents").select(
        d.alias("id"), F.concat(F.lit("Record "), "lang").alias("title"), F.col("text").alias("description"), F.concat(F.lit("copy of "), "source").alias("transcription"),
        F.when(d % 7 == 0, "licensed copy").alias("annotation"), (d % 17 == 0).cast("int").alias("is_trashed"), F.when(d % 5 == 0, d).alias("group_id"), F.col("source").alias("source_archive"),
    )


def _named(a):
    """Entities by the documents that are linked to them."""
    name = F.when(F.col("source").isin("src1", "src2"), F.concat("source", F.lit(" MIT archive"))).otherwise(F.col("source"))
    return a.raw("documents").select(F.col("doc_id").alias("id"), name.alias("name"))


_WORLD = r"""wd AS (SELECT doc_id AS id, 'Record ' || lang AS title, text AS description, 'copy of ' || source AS transcription, CASE WHEN doc_id % 7 = 0 THEN 'licensed copy' END AS annotation,
  doc_id % 17 <> 0 AND doc_id % 5 <> 0 AS live, source, CASE WHEN source IN ('src1', 'src2') THEN source || ' MIT archive' ELSE source END AS name FROM documents),
 wl AS (SELECT id, list_transform([title, description, transcription, annotation], lambda x: regexp_extract_all(lower(coalesce(x, '')), '[\p{L}\p{N}]+')) AS f FROM wd),
 ix AS (SELECT id, f, list_sum(list_transform(f, lambda w: len(w))) AS length FROM wl), co AS (SELECT count(*) AS n, avg(length) AS ml FROM ix)"""


def _hits(tf: str) -> str:
    return f"hits AS (SELECT id, length, CAST(list_sum(list_transform(f, lambda w: {tf})) AS BIGINT) AS tf FROM ix), hh AS (SELECT count(*) AS h FROM hits WHERE tf > 0), sc AS (SELECT id, tf, round(greatest(ln((co.n - hh.h + 0.5) / (hh.h + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / co.ml)), 6) AS score FROM hits, co, hh WHERE tf > 0)"


def _prefix(word: str) -> str:
    return _hits(f"len(list_filter(w, lambda x: starts_with(x, '{word}')))")


_PHRASE = _hits("len(list_filter(range(1, len(w)), lambda i: w[i] = 'licensed' AND w[i + 1] = 'under'))")


@_q("search_prefix_fields", _WORLD, _prefix("licen"), "SELECT * FROM sc")
def search_prefix_fields(a):
    """Over four columns."""
    docs = _world(a)
    return postings.scored(postings.prefix(postings.build(docs), "licen"), postings.lengths(docs))


@_q("search_phrase_fields", _WORLD, _PHRASE, "SELECT * FROM sc")
def search_phrase_fields(a):
    """X2, X4"""
    docs = _world(a)
    return postings.scored(postings.phrase(postings.build(docs), ["licensed", "under"]), postings.lengths(docs))


@_q("search_phrase_repeats", _WORLD, "SELECT id, CAST(list_sum(list_transform(f, lambda w: len(list_filter(range(1, len(w) + 1), lambda i: w[i] = w[i + 1] AND w[i] = 'a')))) AS BIGINT) AS tf FROM ix WHERE len(list_filter(f, lambda w: len(list_filter(range(1, len(w) + 1), lambda i: w[i] = w[i + 1] AND w[i] = 'a')) > 0)) > 0")
def search_phrase_repeats(a):
    """A word that repeats itself, overlaps and all."""
    return postings.phrase(postings.build(_world(a)), ["a", "a"])


_FOUND = "al AS (SELECT id, 1 AS p, score FROM sc UNION ALL SELECT id, 2, 0.5 FROM wd WHERE contains(lower(name), 'mit')), best AS (SELECT id, arg_min(score, p) AS score FROM al GROUP BY 1)"


@_q("search_keyword_page", _WORLD, _prefix("mit"), _FOUND, "SELECT id, title, score FROM best JOIN wd USING (id) WHERE live ORDER BY score DESC, id LIMIT 40 OFFSET 40")
def search_keyword_page(a):
    """The second page of live records."""
    return postings.results(_world(a), _named(a), "MIT", number=2, per_page=40).select("id", "title", "score")


@_q("search_phrase_filtered", _WORLD, _PHRASE, "SELECT id, title, score FROM sc JOIN wd USING (id) WHERE live AND source = 'src3' ORDER BY score DESC, id LIMIT 50")
def search_phrase_filtered(a):
    """Filters come after the index's statistics."""
    return postings.results(_world(a), _named(a), '"Licensed under"', archive="src3").select("id", "title", "score")


@_q("search_empty_browses", _WORLD, "SELECT id, title, CAST(0 AS DOUBLE) AS score FROM wd WHERE live AND source = 'src4' ORDER BY id LIMIT 50")
def search_empty_browses(a):
    """An empty query with a filter, and without one."""
    none = postings.results(_world(a), _named(a), ' " ').select("id", "title", "score")
    return postings.results(_world(a), _named(a), "", archive="src4").select("id", "title", "score").unionByName(none)


_SAID = r"""sd AS (SELECT doc_id AS id, regexp_split_to_array(trim(text, E' \t\n\r'), '\s+') AS w FROM documents WHERE text IS NOT NULL),
 bg AS (SELECT id, w, list_transform(w, lambda x: starts_with(regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), 'licen')) AS b FROM sd),
 st AS (SELECT id, w, b, CAST(greatest(0, least(coalesce(nullif(list_position(b, true), 0), 0) - 17, len(w) - 64)) AS BIGINT) AS s FROM bg WHERE list_contains(b, true))"""


@_q("search_snippets", _SAID, "SELECT id, CASE WHEN s > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(s + 1, least(s + 64, len(w)) + 1), lambda i: CASE WHEN b[i] THEN '<mark>' || w[i] || '</mark>' ELSE w[i] END), ' ') || CASE WHEN s + 64 < len(w) THEN '…' ELSE '' END AS snippet FROM st")
def search_snippets(a):
    """The words around the first hit."""
    docs = a.raw("documents").where("text is not null").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("body"))
    return docs.select("id", postings.snippet(F.col("body"), ["licen"]).alias("snippet")).where(F.contains("snippet", F.lit("<mark>")))


@_q("search_stored_index", _WORLD, _prefix("licen"), "SELECT id, tf FROM sc")
def search_stored_index(a):
    """A prefix read from one folder of a stored index."""
    path = shared.place(a.spark, "index")
    postings.store(postings.build(_world(a)), path)
    return postings.prefix(postings.stored(a.spark, path, "licen"), "licen")


@_q("search_index_kept_up", _WORLD, "SELECT id, CAST(count(*) AS BIGINT) AS words, CAST(count(*) FILTER (t = 'amended') AS BIGINT) AS amended FROM (SELECT id, unnest(flatten(f)) AS t FROM wl WHERE id % 3 <> 1 AND id % 3 <> 2 UNION ALL SELECT id, unnest(list_concat(flatten([f[1], f[3], f[4]]), ['amended', 'text'])) FROM wl WHERE id % 3 = 1) GROUP BY 1")
def search_index_kept_up(a):
    """A third of the documents changed, a third removed."""
    docs = _world(a)
    changed = docs.where("id % 3 = 1").withColumn("description", F.lit("Amended text"))
    index = postings.updated(postings.build(docs), changed, docs.where("id % 3 = 2"))
    return index.groupBy("id").agg(F.count("*").alias("words"), F.count_if(F.col("term") == "amended").alias("amended"))


_NEAR = _EMB
_ASKED = _TOK.replace("tk AS", "qk AS").replace("doc_id AS id", "item_id AS id").replace("FROM documents", "FROM benchmark WHERE item_id NOT IN (SELECT question_id FROM hit)")
_ASKED_EMB = _EMB.replace("em AS", "qm AS").replace("tf AS (SELECT", "qtf AS (SELECT").replace("FROM tk", "FROM qk").replace("hx AS", "qhx AS").replace("FROM tf", "FROM qtf").replace("sl AS", "qsl AS").replace("FROM hx", "FROM qhx").replace("nm AS", "qnm AS").replace("FROM sl GROUP", "FROM qsl GROUP").replace("SELECT sl.id", "SELECT qsl.id").replace("FROM sl JOIN nm ON nm.id = sl.id", "FROM qsl JOIN qnm ON qnm.id = qsl.id")


@_q("search_fallback", _WORDS, _RAG, _TOK, _NEAR, _ASKED, _ASKED_EMB, """SELECT question_id, id, how, CAST(rank AS INT) AS rank FROM (SELECT question_id, id, 'phrase' AS how, row_number() OVER (PARTITION BY question_id ORDER BY tf DESC, id) AS rank FROM hit
 UNION ALL SELECT question_id, id, 'similar', row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) FROM (SELECT q.id AS question_id, e.id, round(sum(e.weight * q.weight), 6) AS score FROM em e JOIN qm q ON q.slot = e.slot GROUP BY 1, 2)) WHERE rank <= 15""")
def search_fallback(a):
    """Phrase hits, or the most similar documents where a question has none."""
    docs = a.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    asked = a.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return text.retrieved(docs, "description", asked).select("question_id", "id", "how", "rank")
