"""A positional index of several columns, and search over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import text
from folioworks.operators.records import NONE, from_archive

FIELDS = ("title", "description", "transcription", "annotation")
#: Folders of a stored index; a prefix of two letters or more reads one of them.
BUCKETS = 64
#: Words of a snippet, and how many of them stand before the first hit.
SHOWN, LEAD = 64, 16


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, at, term), a row for each word."""
    each = F.array(*(F.struct(F.lit(c).alias("field"), exprs.words(F.col(c)).alias("words")) for c in fields))
    rows = docs.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.words")
    return rows.select("id", "field", F.posexplode("words").alias("at", "term"))


def lengths(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every document's words in all fields."""
    return docs.select("id", sum((F.size(exprs.words(F.col(c))) for c in fields), F.lit(0)).alias("length"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, 1, 2)), F.lit(BUCKETS)).cast("int")


def store(postings: DataFrame, path: str) -> None:
    """The index as files in a folder for each bucket of the terms' first two letters."""
    postings.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", "id").write.partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str, word: str) -> DataFrame:
    """The part of a stored index in which a word, or the words that begin with it, stand."""
    out = spark.read.parquet(path)
    if len(word) >= 2:
        (number,) = spark.range(1).select(_bucket(F.lit(word))).first()
        out = out.where(F.col("bucket") == number)
    return out.drop("bucket")


def updated(postings: DataFrame, changed: DataFrame, gone: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The index after documents were changed, added or removed (gone: id)."""
    touched = changed.select("id").union(gone.select("id"))
    return postings.join(touched, "id", "left_anti").unionByName(build(changed, fields))


def prefix(postings: DataFrame, word: str) -> DataFrame:
    """(id, tf) of words that begin with it, in any field."""
    return postings.where(F.col("term").startswith(word)).groupBy("id").agg(F.count("*").alias("tf"))


def phrase(postings: DataFrame, words: list[str]) -> DataFrame:
    """(id, tf) of words in sequence within a field; overlapping repeats count."""
    found = postings.where(F.col("term") == words[0]).select("id", "field", "at")
    for n, word in enumerate(words[1:], 1):
        found = found.join(postings.where(F.col("term") == word).select("id", "field", (F.col("at") - n).alias("at")), ["id", "field", "at"])
    return found.groupBy("id").agg(F.count("*").alias("tf"))


def scored(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """BM25 by the size and mean length of the whole index, filters or not; two aggregates of one row each."""
    corpus = sizes.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    number = hits.agg(F.count("*").alias("n_hit"))
    score = text.bm25(F.col("tf"), F.col("length"), F.col("n_docs"), F.col("n_hit"), F.col("mean_length"))
    return hits.join(sizes, "id").crossJoin(corpus).crossJoin(number).select("id", "tf", F.round(score, 6).alias("score"))


def snippet(body: Column, words: list[str]) -> Column:
    """A window of the text around its first hit, hits marked as a whole; the text's start if there is none.

    Words are split at white space; a single word marks those that begin with it, several mark their sequence.
    """
    said = F.split(F.trim(F.coalesce(body, F.lit(""))), r"\s+")
    last = len(words) - 1

    def alike(x: Column, n: int) -> Column:
        bare = F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        return bare.startswith(words[0]) if not last else bare == words[n]

    # each word with those that follow it
    follow = F.arrays_zip(*(F.slice(said, n + 1, F.greatest(F.size(said), F.lit(1))) for n in range(last + 1)))

    def hit(x: Column) -> Column:
        out = alike(x["0"], 0)
        for n in range(1, last + 1):
            out = out & F.coalesce(alike(x[str(n)], n), F.lit(False))
        return F.coalesce(out, F.lit(False))

    begins = F.transform(follow, hit)
    start = F.greatest(F.lit(0), F.least(F.coalesce(F.array_position(begins, F.lit(True)), F.lit(0)) - 1 - LEAD, F.size(said) - SHOWN)).cast("int")
    window, marks = F.slice(said, start + 1, F.lit(SHOWN)), F.slice(begins, start + 1, F.lit(SHOWN))
    ends = F.concat(F.array_repeat(F.lit(False), last), marks) if last else marks
    shown = F.zip_with(window, marks, lambda w, b: F.when(b, F.concat(F.lit("<mark>"), w)).otherwise(w))
    shown = F.zip_with(shown, ends, lambda w, e: F.when(e & w.isNotNull(), F.concat(w, F.lit("</mark>"))).otherwise(w))
    shown = F.array_join(F.slice(shown, 1, SHOWN), " ")
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), shown, F.when(start + SHOWN < F.size(said), F.lit("…")).otherwise(""))


def results(docs: DataFrame, named: DataFrame, query: str, *, archive: str | None = None, number: int = 1, per_page: int = 50) -> DataFrame:
    """A page of the live standalone documents that a typed query finds: (id, title, score, snippet), best first.

    Full-text hits come before records that an entity whose name holds the query is linked to
    (named: id, name), which score 0.5. An empty query browses the filters' records, or finds nothing.
    """
    kind, words = text.escaped(query)
    live = docs.where((F.col("is_trashed") == 0) & F.col("group_id").isNull() & from_archive(archive))
    if kind == "empty":
        found = live.select("id", F.lit(0.0).alias("score")).where(F.lit(archive is not None))
    else:
        index = build(docs)
        hits = scored(prefix(index, words[0]) if kind == "prefix" else phrase(index, words), lengths(docs))
        linked = named.where(F.contains(F.lower("name"), F.lit(query.strip(' "').lower()))).select("id", F.lit(2).alias("priority"), F.lit(0.5).alias("score"))
        both = hits.select("id", F.lit(1).alias("priority"), "score").unionByName(linked)
        found = both.groupBy("id").agg(F.min_by("score", "priority").alias("score"))
    page = found.join(live, "id").orderBy(F.desc("score"), "id").offset((max(1, number) - 1) * per_page).limit(per_page)
    return page.select("id", "title", "score", snippet(F.col("description"), words or [""]).alias("snippet"))


__all__ = ["FIELDS", "NONE", "build", "lengths", "phrase", "prefix", "results", "scored", "snippet", "store", "stored", "updated"]
