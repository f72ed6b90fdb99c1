"""Queries over the stored indexes of documents and groups, and their fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import search, text
from folioworks.operators.search import Corpus, Filters
from folioworks.operators.segments import Index
from folioworks.plans.ctes import sql
from folioworks.plans.library import _EMB, _TOK
from folioworks.plans.registry import query
from folioworks.sources import shared
from folioworks.sources.archive import Archive


def _q(name, *parts):
    def put(fn):
        query(name, sql(*parts))(lambda spark, folder: fn(Archive(spark, folder)))
        return fn

    return put


def _documents(a):
    d = F.col("doc_id")
    return a.raw("documents").select(
        d.alias("id"), F.concat(F.lit("Record "), "lang").alias("title"), F.col("text").alias("description"), F.concat(F.lit("copy of "), "source").alias("transcription"),
        F.when(d % 7 == 0, "licensed copy").alias("annotation"), (d % 17 == 0).cast("int").alias("is_trashed"), F.when(d % 5 == 0, F.floor(d / 50)).alias("group_id"), F.col("source").alias("source_archive"),
        F.when(d % 11 != 0, F.date_add(F.lit("1900-01-01").cast("date"), (d * 37 % 20000).cast("int")).cast("string")).alias("date_depicted"), "lang",
    )


def _groups(docs):
    """Groups of the documents that name one: their pages' texts in order."""
    pages = F.array_sort(F.collect_list(F.struct("id", "description")))
    own = docs.where("group_id is not null").groupBy("group_id").agg(F.array_join(F.transform(pages, lambda p: p["description"]), " ").alias("description"), F.min("source_archive").alias("source_archive"), F.min("date_depicted").alias("date_depicted"), F.min("lang").alias("lang"))
    g = F.col("group_id")
    return own.select(g.alias("id"), F.concat(F.lit("Group "), g).alias("title"), "description", F.lit(None).cast("string").alias("transcription"), F.when(g % 3 == 0, "licensed set").alias("annotation"), (g % 7 == 0).cast("int").alias("is_trashed"), "source_archive", "date_depicted", "lang")


class _WhenRead(Index):
    """An index of records that is made when it is first read."""

    records, making = None, False

    def version(self):
        if not self.making:
            self.making = True
            self.update(self.records)
        return super().version()


def _corpus(a, staged=True):
    """staged: groups are read several times."""
    docs = _documents(a)
    groups = shared.staged(_groups(docs), "groups") if staged else _groups(docs)
    place = shared.place(a.spark, "indexes")
    indexes = [_WhenRead(a.spark, f"{place}/{name}", buckets=16, splits=1) for name in ("documents", "groups")]
    for index, records in zip(indexes, (docs, groups)):
        index.records = records
    source = F.col("source_archive").alias("entity_id")
    names = docs.select(source).distinct().select("entity_id", F.when(F.col("entity_id").isin("src1", "src2"), F.concat("entity_id", F.lit(" MIT archive"))).otherwise(F.col("entity_id")).alias("name"))
    links = [x.select(F.col("id").alias(key), source) for x, key in ((docs, "document_id"), (groups, "group_id"))]
    tags = [x.select(F.col("id").alias(key), F.col("lang").alias("tag")) for x, key in ((docs, "document_id"), (groups, "group_id"))]
    return Corpus(docs, groups, names, *links, *tags, *indexes)


_WORLD = r"""wd AS (SELECT doc_id AS id, 'Record ' || lang AS title, text AS description, 'copy of ' || source AS transcription, CASE WHEN doc_id % 7 = 0 THEN 'licensed copy' END AS annotation,
  doc_id % 17 = 0 AS trashed, CASE WHEN doc_id % 5 = 0 THEN doc_id // 50 END AS group_id, source, lang, CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '1900-01-01' + CAST(doc_id * 37 % 20000 AS INT), '%Y-%m-%d') END AS date_depicted FROM documents),
 wg AS (SELECT group_id AS id, 'Group ' || group_id AS title, string_agg(description, ' ' ORDER BY id) AS description, CAST(NULL AS VARCHAR) AS transcription, CASE WHEN group_id % 3 = 0 THEN 'licensed set' END AS annotation,
  group_id % 7 = 0 AS trashed, min(source) AS source, min(lang) AS lang, min(date_depicted) AS date_depicted FROM wd WHERE group_id IS NOT NULL GROUP BY group_id)"""


def _index(table: str, p: str) -> str:
    return rf"{p}ix AS (SELECT id, f, list_sum(list_transform(f, lambda w: len(w))) AS length FROM (SELECT id, list_transform([title, description, transcription, annotation], lambda x: regexp_extract_all(lower(coalesce(x, '')), '[\p{{L}}\p{{N}}]+')) AS f FROM {table})), {p}co AS (SELECT count(*) AS n, avg(length) AS ml FROM {p}ix)"


def _scores(tf: str, p: str) -> str:
    return f"{p}hits AS (SELECT id, length, CAST(list_sum(list_transform(f, lambda w: {tf})) AS BIGINT) AS tf FROM {p}ix), {p}hh AS (SELECT count(*) AS h FROM {p}hits WHERE tf > 0), {p}sc AS (SELECT id, tf, round(greatest(ln((n - h + 0.5) / (h + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ml)), 6) AS score FROM {p}hits, {p}co, {p}hh WHERE tf > 0)"


_LICENSED_UNDER = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'licensed' AND w[i + 1] = 'under'))"
_LICEN = "len(list_filter(w, lambda x: starts_with(x, 'licen')))"
_MIT = "len(list_filter(w, lambda x: starts_with(x, 'mit')))"


def _found(named: str, passes: str) -> str:
    """All sources of a search, each record as first found."""
    name = "CASE WHEN source IN ('src1', 'src2') THEN source || ' MIT archive' ELSE source END"
    return f"""al AS (SELECT 'document' AS record_type, id, title, score, 1 AS source FROM dsc JOIN wd USING (id) WHERE NOT trashed AND group_id IS NULL AND {passes}
  UNION ALL SELECT 'group', id, title, score, 2 FROM gsc JOIN wg USING (id) WHERE NOT trashed
  UNION ALL SELECT 'document', id, title, 0.5, 3 FROM wd WHERE NOT trashed AND group_id IS NULL AND contains(lower({name}), '{named}')
  UNION ALL SELECT 'group', id, title, 0.5, 4 FROM wg WHERE NOT trashed AND contains(lower({name}), '{named}')),
 fo AS (SELECT record_type, id, arg_min(title, source) AS title, arg_min(score, source) AS score, CAST(min(source) AS INT) AS source FROM al GROUP BY 1, 2)"""


def _both(tf: str) -> tuple[str, ...]:
    return _WORLD, _index("wd", "d"), _index("wg", "g"), _scores(tf, "d"), _scores(tf, "g")


@_q("search_two_indexes", *_both(_LICENSED_UNDER), _found("licensed under", "lang IN ('en', 'fr')"), "SELECT * FROM fo")
def search_two_indexes(a):
    """A phrase, with a filter for tags; each score by its own index."""
    return search.keyword(_corpus(a), "Licensed under", Filters(tags=("en", "fr"))).select("record_type", "id", "title", "score", "source")


@_q("search_two_indexes_page", *_both(_MIT), _found("mit", "source = 'src1'"), "SELECT record_type, id, title, score, source FROM fo ORDER BY score DESC, source, id LIMIT 40 OFFSET 40")
def search_two_indexes_page(a):
    """A prefix, with filters for an entity and an archive; the second page."""
    found = search.keyword(_corpus(a), "MIT", Filters(entity_id="src1", archive="src1"))
    return search.page(found, 2, 40).select("record_type", "id", "title", "score", "source")


@_q("search_two_indexes_browse", _WORLD, "al AS (SELECT 'document' AS record_type, id, title, date_depicted, 1 AS source FROM wd WHERE NOT trashed AND lang = 'de' AND wd.source = 'src3' UNION ALL SELECT 'group', id, title, date_depicted, 2 FROM wg WHERE NOT trashed AND lang = 'de' AND wg.source = 'src3')", "SELECT record_type, id, title FROM al ORDER BY source, date_depicted DESC NULLS LAST, id DESC LIMIT 30")
def search_two_indexes_browse(a):
    """An empty query with filters for a tag and an entity; one without any finds nothing."""
    c = _corpus(a)
    none = search.keyword(c, " ").select("record_type", "id", "title")
    return search.page(search.keyword(c, ' "" ', Filters(tags=("de",), entity_id="src3")), 1, 30).select("record_type", "id", "title").unionByName(none)


_KEPT = r"""kd AS (SELECT id, title, CASE WHEN id % 3 = 1 AND id % 4 <> 0 THEN 'Amended under licence, licensed under ' || lang ELSE description END AS description, transcription, annotation FROM wd WHERE id % 3 <> 2 OR id % 5 = 0
 UNION ALL SELECT id + 10000000, title, 'licensed under a new record', transcription, annotation FROM wd WHERE id % 4 = 0)"""


def _kept_up(a):
    """An index of three segments: all documents; a third changed, a third removed; some brought back or restored, some new."""
    docs = _documents(a)
    index = Index(a.spark, shared.place(a.spark, "kept-up"), buckets=16, splits=1)
    index.update(docs)
    amended = docs.where("id % 3 = 1").withColumn("description", F.concat(F.lit("Amended under licence, licensed under "), "lang"))
    index.update(amended, docs.where("id % 3 = 2"))
    back = docs.where("id % 3 = 2 and id % 5 = 0 or id % 3 = 1 and id % 4 = 0")
    new = docs.where("id % 4 = 0").withColumns({"id": F.col("id") + 10_000_000, "description": F.lit("licensed under a new record")})
    index.update(back.unionByName(new))
    return index


@_q("search_from_store", _WORLD, _KEPT, _index("kd", "d"), _scores(_LICEN, "d"), "SELECT * FROM dsc")
def search_from_store(a):
    """A prefix by the store alone, after two updates."""
    return _kept_up(a).scored("licen")


@_q("search_from_store_merged", _WORLD, _KEPT, _index("kd", "d"), _scores(_LICENSED_UNDER, "d"), "SELECT * FROM dsc")
def search_from_store_merged(a):
    """A phrase by the store alone, after two updates, a merge of one word's bucket, and an update more."""
    index = _kept_up(a)
    index.merge(index.buckets(["under"])[0])
    index.update(_documents(a).where("id % 3 = 0 and id % 30 = 0"))
    return index.scored('"licensed  under"')


@_q("search_store_totals", _WORLD, _KEPT, _index("kd", "d"), "SELECT n AS n_docs, CAST((SELECT sum(length) FROM dix) AS BIGINT) AS total FROM dco")
def search_store_totals(a):
    """What the version says of the corpus after two updates, beside what is in the store."""
    v = _kept_up(a).version()
    return a.spark.createDataFrame([(v.n_docs, v.total)], "n_docs long, total long")


_SEM = _TOK, _EMB, "qv AS (SELECT slot, weight FROM em WHERE id = 7)"


@_q("search_semantic_filtered", _WORLD, *_SEM, "SELECT id, title, round(coalesce(dot, 0), 6) AS score FROM wd JOIN (SELECT id, sum(em.weight * qv.weight) AS dot FROM em LEFT JOIN qv USING (slot) GROUP BY 1) USING (id) WHERE NOT trashed AND lang = 'en' ORDER BY 3 DESC, id LIMIT 50")
def search_semantic_filtered(a):
    """V1: live documents with a tag, by likeness to the text of one."""
    c = _corpus(a, staged=False)  # groups are read only where no vector is found
    vectors = text.spread(shared.staged(text.vectors(c.docs, "description"), "vectors"))
    asked = vectors.where("id = 7").select("slot", "weight")
    return search.page(search.semantic(c, vectors, asked, "text of 7", Filters(tags=("en",)))).select("id", "title", "score")


@_q("search_semantic_or_keyword", *_both(_LICEN), _found("licen", "lang = 'de'"), "SELECT 'no vectors' AS why, * FROM fo UNION ALL SELECT 'no question', * FROM fo")
def search_semantic_or_keyword(a):
    """V2: keyword search where the question, or every document that passes the filters, has no vector; its archive filter is dropped."""
    c = _corpus(a)
    vectors = text.spread(shared.staged(text.vectors(c.docs.where("lang <> 'de'"), "description"), "vectors"))
    asked, filters = vectors.where("id = 7").select("slot", "weight"), Filters(tags=("de",), archive="src2")
    one = search.semantic(c, vectors, asked, "licen", filters).withColumn("why", F.lit("no vectors"))
    two = search.semantic(c, text.embedding(c.docs, "description"), asked.limit(0), "licen", filters).withColumn("why", F.lit("no question"))
    return one.unionByName(two).select("why", "record_type", "id", "title", "score", "source")
