"""A full-text index that is stored, searched where it lies, and kept up by segments.

    <path>/postings/segment=N/bucket=B   term, id, field, positions, length; sorted by term
                             bucket=-1   a row for each document: id, length
                             bucket=-2   term, and how many of a batch's documents hold it, as length
    <path>/terms/segment=N               bucket, term, n: documents of the segment that hold it; sorted by term
    <path>/touched/segment=N             ids whose older rows are dead, and their length; null: gone
    <path>/versions                      what is in force: segments, buckets' merged segments, totals

A segment is written whole before the version that names it, and a version is made once (sources.log), so a
reader sees all of an update or nothing, and of two writers one fails. A search reads the buckets of its
words' first two letters, filtered by term, and drops rows of documents that a later segment touched; no text
is read, and the size and mean length of the corpus are in the version. A merge writes one bucket without its
dead rows and names that for it instead of the older segments.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import postings, text
from folioworks.sources import log, shared

BUCKETS = postings.BUCKETS
#: Words of a task that writes a segment, and the fewest letters that a word counts for; a task makes a file in each bucket.
WORDS, LETTERS = 1_000_000, 4
#: In place of a bucket: documents' lengths, and terms' counts by batch.
LENGTHS, COUNTS = -1, -2
_POSTINGS = "term string, id long, field int, positions array<int>, length int"


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, 1, 2)), F.lit(buckets)).cast("int")


def _placed(fields: int):
    """Rows (id, said), said being the words of each field, as rows of their different words with their places, in order of the
    words; then the rows of LENGTHS and COUNTS, under these as `field`."""
    names = ["term", "id", "field", "positions", "length"]

    def rows(term, id_, field, ends, places, length):
        positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([term, id_, pa.array(field, pa.int32()), positions, pa.array(length, pa.int32())], names=names)

    def run(batches):
        for batch in batches:
            lists = batch.column("said").flatten()  # one for each document's field
            sizes = np.diff(lists.offsets.to_numpy())
            row, place = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            length = sizes.reshape(-1, fields).sum(axis=1)
            said = lists.flatten().dictionary_encode()
            if len(said):
                order = pc.sort_indices(said.dictionary).to_numpy()
                terms, rank = said.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                key = rank[said.indices.to_numpy()] * len(sizes) + row
                order = np.argsort(key, kind="stable")  # places of a word stay in order
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                code, of = np.divmod(key[first], len(sizes))
                doc = of // fields
                yield rows(terms.take(pa.array(code)), batch.column("id").take(pa.array(doc)), of % fields, np.append(first, len(key)), place[order], length[doc])
                new = (np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)  # a term counts once in a document's fields
                n = len(terms)
                yield rows(terms, pa.nulls(n, pa.int64()), np.full(n, COUNTS), np.zeros(n + 1), [], np.bincount(code[new], minlength=n))
            n = batch.num_rows
            yield rows(pa.nulls(n, pa.string()), batch.column("id"), np.full(n, LENGTHS), np.zeros(n + 1), [], length)

    return run


@dataclass
class Version:
    number: int
    updates: list[int]  # segments that updates wrote, in order of age
    merged: dict[str, int]  # of a bucket that was merged, the segment that holds all of its older rows
    folders: dict[str, str]  # of each segment
    buckets: int
    n_docs: int
    total: int  # words

    @property
    def mean_length(self) -> float | None:
        return self.total / self.n_docs if self.n_docs else None

    @property
    def next(self) -> int:
        return max(map(int, self.folders), default=-1) + 1


class Conflict(RuntimeError):
    """Another writer made the version."""


class Index:
    """buckets: of an index that is made; one that is there keeps its own. splits: the least files of a bucket in a segment, over which
    documents are dealt; a segment has more as it has more words."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = postings.FIELDS, buckets: int = BUCKETS, splits: int = 8):
        self.spark, self.path, self.fields, self.new_buckets, self.splits = spark, path, fields, buckets, splits

    # versions

    def version(self) -> Version:
        number, content = log.last(self.spark, f"{self.path}/versions")
        return Version(number, [], {}, {}, self.new_buckets, 0, 0) if content is None else Version(number, **content)

    def _commit(self, old: Version, **new) -> None:
        content = {"updates": old.updates, "merged": old.merged, "folders": old.folders, "buckets": old.buckets, "n_docs": old.n_docs, "total": old.total} | new
        if not log.put(self.spark, f"{self.path}/versions", old.number + 1, content):
            raise Conflict(f"version {old.number + 1} of {self.path}")

    # writing

    def _dealt(self, rows: DataFrame, words: int) -> DataFrame:
        """Rows by document, in tasks of about WORDS words, so a task's work grows neither with the segment nor with a bucket's share of it."""
        return rows.repartition(max(self.splits, -(-words // WORDS)), "id")

    def _rows(self, docs: DataFrame, buckets: int) -> DataFrame:
        """The rows of a segment: texts are cut into words, and these grouped within their document, in one pass over them."""
        texts = [F.coalesce(F.col(c), F.lit("")) for c in self.fields]
        letters = docs.agg(F.sum(sum((F.length(t) for t in texts), F.lit(0)))).first()[0] or 0
        said = self._dealt(docs.select("id", *self.fields), letters // LETTERS).select("id", F.array(*(exprs.words(F.col(c)) for c in self.fields)).alias("said"))
        shared.importable(self.spark)
        place = F.when(F.col("field") < 0, F.col("field")).otherwise(_bucket(F.col("term"), buckets))
        return said.mapInArrow(_placed(len(self.fields)), _POSTINGS).withColumn("bucket", place)

    def _write(self, segment: int, folder: str, rows: DataFrame) -> None:
        rows.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}/{folder}")

    def _part(self, segment: int, folder: str, bucket: int) -> DataFrame:
        path = f"{self.path}/postings/segment={segment}/{folder}/bucket={bucket}"
        return self.spark.read.schema(_POSTINGS).parquet(path) if log.there(self.spark, path) else self.spark.createDataFrame([], _POSTINGS)

    def _terms(self, segment: int, folder: str, counts: DataFrame) -> None:
        held = shared.staged(counts, "terms")  # a range exchange reads its rows twice
        held.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/terms/segment={segment}/{folder}")

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> Version:
        """Documents added or changed (id and the fields), and removed (id), as one segment; the first makes the index."""
        old = self.version()
        segment, folder = old.next, uuid.uuid4().hex
        self._write(segment, folder, self._rows(changed, old.buckets))
        now = self._part(segment, folder, LENGTHS).select("id", F.col("length").cast("long").alias("length"))
        if gone is not None:
            removed = gone.select("id").distinct().join(now.select("id"), "id", "left_anti")
            now = now.unionByName(removed.withColumn("length", F.lit(None).cast("long")))
        now.write.parquet(f"{self.path}/touched/segment={segment}/{folder}")
        now = self.spark.read.schema("id long, length long").parquet(f"{self.path}/touched/segment={segment}/{folder}")
        n, total = now.agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
        counts = self._part(segment, folder, COUNTS).groupBy("term").agg(F.sum("length").alias("n"))
        self._terms(segment, folder, counts.select(_bucket(F.col("term"), old.buckets).alias("bucket"), "term", "n"))
        if old.updates:
            was = self._lengths(old, now.select("id")).agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
            n, total = n - was[0], total - was[1]
        self._commit(old, updates=[*old.updates, segment], folders=old.folders | {str(segment): folder}, n_docs=old.n_docs + n, total=old.total + total)
        return self.version()

    def merge(self, bucket: int) -> Version:
        """One bucket written anew without its dead rows; other buckets and readers of older versions keep what they have."""
        old = self.version()
        segment, folder = old.next, uuid.uuid4().hex
        rows = self._postings(old, [bucket])
        self._write(segment, folder, self._dealt(self._alive(old, rows).drop("segment"), rows.count()))
        held = self.spark.read.schema(_POSTINGS + ", bucket int").parquet(f"{self.path}/postings/segment={segment}/{folder}")
        self._terms(segment, folder, held.groupBy("bucket", "term").agg(F.countDistinct("id").alias("n")))
        self._commit(old, folders=old.folders | {str(segment): folder}, merged=old.merged | {str(bucket): segment})
        return self.version()

    # reading

    def _lengths(self, v: Version, ids: DataFrame) -> DataFrame:
        """(id, length) of those of the documents that are live."""
        return self._touched(v).join(ids, "id", "left_semi").groupBy("id").agg(F.max_by("length", "segment").alias("length")).where("length is not null")

    def _touched(self, v: Version, after: int = -1) -> DataFrame:
        out = self.spark.createDataFrame([], "id long, length long, segment int")
        for n in v.updates:
            if n > after:
                out = out.unionByName(self.spark.read.schema("id long, length long").parquet(f"{self.path}/touched/segment={n}/{v.folders[str(n)]}").withColumn("segment", F.lit(n)))
        return out

    def _segments(self, v: Version, bucket: int) -> list[int]:
        """The segments of a bucket in force: those from its merge on."""
        first = v.merged.get(str(bucket), -1)
        return [first] * (first >= 0) + [n for n in v.updates if n > first]

    def _postings(self, v: Version, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/postings/segment={n}/{v.folders[str(n)]}/bucket={b}" for b in buckets for n in self._segments(v, b)]
        paths = [p for p in paths if log.there(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], _POSTINGS + ", segment int, bucket int")
        parts = self.spark.read.schema(_POSTINGS).parquet(*paths)
        name = F.col("_metadata.file_path")
        return parts.withColumns({"segment": F.regexp_extract(name, r"segment=(\d+)", 1).cast("int"), "bucket": F.regexp_extract(name, r"bucket=(\d+)", 1).cast("int")})

    def _alive(self, v: Version, rows: DataFrame) -> DataFrame:
        """Without rows of documents that a later segment touched; what merges wrote is as old as its last update."""
        later = self._touched(v, min(v.updates, default=0))
        newest = later.groupBy("id").agg(F.max("segment").alias("newest"))
        return rows.join(newest, "id", "left").where("newest is null or newest <= segment").drop("newest")

    def buckets(self, words: list[str], v: Version | None = None) -> list[int]:
        """The words' buckets."""
        v = v or self.version()
        (row,) = self.spark.range(1).select(F.array(*(_bucket(F.lit(w), v.buckets) for w in words))).collect()
        return sorted(set(row[0]))

    def prefix(self, word: str, v: Version | None = None) -> DataFrame:
        """(id, tf, length) of the words that begin with it, in any field; one letter reads all buckets."""
        v = v or self.version()
        rows = self._postings(v, self.buckets([word], v) if len(word) > 1 else [*range(v.buckets)]).where(F.col("term").startswith(word))
        return self._alive(v, rows).groupBy("id").agg(F.sum(F.size("positions")).alias("tf"), F.first("length").alias("length"))

    def phrase(self, words: list[str], v: Version | None = None) -> DataFrame:
        """(id, tf, length) of words in sequence within a field; the rarest word, by the stored counts, comes first."""
        v = v or self.version()
        counts = self.frequencies(words, v)
        rows, found = self._alive(v, self._postings(v, self.buckets(words, v)).where(F.col("term").isin(*words))), None
        for n in sorted(range(len(words)), key=lambda n: (counts.get(words[n], 0), n)):
            places = rows.where(F.col("term") == words[n]).select("id", "field", "length", F.explode("positions").alias("at")).withColumn("at", F.col("at") - n)
            found = places if found is None else found.join(places.drop("length"), ["id", "field", "at"])
        return found.groupBy("id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))

    def frequencies(self, words: list[str], v: Version | None = None) -> dict[str, int]:
        """How many documents, dead ones too, hold each of the query's words: from the stored counts."""
        v = v or self.version()
        found = self.spark.createDataFrame([], "term string, n long")
        in_force = {b: self._segments(v, b) for b in self.buckets(words, v)}
        for n in sorted({n for those in in_force.values() for n in those}):
            mine = [b for b, those in in_force.items() if n in those]
            rows = self.spark.read.schema("bucket int, term string, n long").parquet(f"{self.path}/terms/segment={n}/{v.folders[str(n)]}")
            found = found.unionByName(rows.where(F.col("bucket").isin(*mine) & F.col("term").isin(*words)).select("term", "n"))
        return {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def scored(self, typed: str) -> DataFrame:
        """(id, tf, score) of a typed query by this index's own size and mean length."""
        v = self.version()
        kind, words = text.escaped(typed)
        if kind == "empty" or not v.n_docs:
            return self.spark.createDataFrame([], "id long, tf long, score double")
        hits = self.prefix(words[0], v) if kind == "prefix" else self.phrase(words, v)
        number = hits.agg(F.count("*").alias("n_hit"))  # one row
        score = text.bm25(F.col("tf"), F.col("length"), F.lit(v.n_docs), F.col("n_hit"), F.lit(v.mean_length))
        return hits.crossJoin(F.broadcast(number)).select("id", "tf", F.round(score, 6).alias("score"))
