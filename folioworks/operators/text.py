"""Full-text and vector search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import exprs
from folioworks.operators import nearest
from folioworks.sources import shared

K1, B, FLOOR = 1.2, 0.75, 1e-6


def escaped(query: str) -> tuple[str, list[str]]:
    """('empty'|'prefix'|'phrase', words) of a typed query."""
    words = query.replace('"', " ").split()
    return ("empty" if not words else "prefix" if len(words) == 1 else "phrase"), [w.lower() for w in words]


def indexed(docs: DataFrame, *columns: str) -> DataFrame:
    """The documents' words, one string for each column with a space at both ends, and the whole length."""
    lists = {f"w_{c}": exprs.words(F.col(c)) for c in columns}
    out = docs.select("id", *(v.alias(k) for k, v in lists.items()))
    return out.select("id", sum((F.size(k) for k in lists), F.lit(0)).alias("length"), *(F.concat(F.lit(" "), F.array_join(k, " "), F.lit(" ")).alias(k) for k in lists))


def bm25(tf: Column, length: Column, n_docs: Column, n_hit: Column, mean_length: Column) -> Column:
    """One term's score; rarity is floored."""
    idf = F.greatest(F.log((n_docs - n_hit + 0.5) / (n_hit + 0.5)), F.lit(FLOOR))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def occurrences(text: Column, words: Column) -> Column:
    """How often the words stand in sequence; repeats that overlap count once (`postings.phrase` counts each)."""
    spaced = F.replace(text, F.lit(" "), F.lit("  "))
    inner = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    return (F.length(spaced) - F.length(F.replace(spaced, inner, F.lit("")))) / F.length(inner)


def _ranked(rows: DataFrame) -> DataFrame:
    """Scores of the rows (id, length, tf) with a hit, by the whole index's size and mean length, an aggregate of one row.

    Rows are staged, so that texts are cut into words once."""
    rows = shared.staged(rows, "counts")
    corpus = rows.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), F.count_if(F.col("tf") > 0).alias("n_hit"))
    score = bm25(F.col("tf"), F.col("length"), F.col("n_docs"), F.col("n_hit"), F.col("mean_length"))
    return rows.where("tf > 0").crossJoin(corpus).select("id", "tf", F.round(score, 6).alias("score"))


def prefix_search(index: DataFrame, column: str, prefix: str) -> DataFrame:
    """Words that begin with the query."""
    found = F.size(F.filter(F.split(F.trim(column), " "), lambda w: w.startswith(prefix)))
    return _ranked(index.select("id", "length", found.cast("long").alias("tf")))


def phrase_search(index: DataFrame, column: str, words: list[str]) -> DataFrame:
    """X2"""
    tf = occurrences(F.col(column), F.lit(" ".join(words)))
    return _ranked(index.select("id", "length", tf.cast("long").alias("tf")))


def snippet(text: Column, word: str, size: int = 64) -> Column:
    """The first words, the found ones marked."""
    shown = F.slice(F.split(F.coalesce(text, F.lit("")), r"\s+"), 1, size)
    body = F.array_join(F.transform(shown, lambda w: F.when(F.lower(w).startswith(word), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")
    return F.concat(body, F.when(F.size(F.split(text, r"\s+")) > size, F.lit("…")).otherwise(""))


def _grams(sizes: list[int], begins: bool):
    """Rows (id, words) as rows (id, gram): 64-bit hashes of the different runs of so many words, or of the first one alone."""

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            lengths = np.diff(lists.offsets.to_numpy())
            said = lists.flatten().dictionary_encode()
            names = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in said.dictionary.to_pylist()], np.uint64)
            word = names[said.indices.to_numpy()]
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            for size in sizes:
                fits = place == 0 if begins else place + size <= lengths[row]
                if begins:
                    fits &= np.minimum(lengths[row], sizes[-1]) == size
                at = np.flatnonzero(fits)
                gram = np.full(len(at), size, np.uint64)
                for k in range(size):
                    gram = (gram ^ word[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                    gram ^= gram >> np.uint64(29)
                order = np.lexsort((gram, row[at]))
                gram, of = gram[order], row[at][order]
                new = np.ones(len(of), bool)
                new[1:] = (np.diff(of) != 0) | (gram[1:] != gram[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of[new])), pa.array(gram[new].view(np.int64))], names=["id", "gram"])

    return run


def phrases_by_question(index: DataFrame, column: str, questions: DataFrame, n: int = 4) -> DataFrame:
    """Every question's phrase against all documents: pairs by the phrase's first n words (all, if fewer), then tested whole.

    (question_id, id, tf); no question is compared with documents that lack its first words. One without words has no phrase.
    """
    shared.importable(index.sparkSession)
    asked = questions.select("question_id", exprs.words(F.col("question")).alias("words")).where(F.size("words") > 0)
    sizes = sorted(r["n"] for r in asked.select(F.least(F.size("words"), F.lit(n)).alias("n")).distinct().collect())  # n lengths at most
    if not sizes:
        return index.select(F.lit(None).cast("long").alias("question_id"), "id", F.lit(None).cast("long").alias("tf")).limit(0)
    phrases = asked.select("question_id", F.array_join("words", " ").alias("phrase"))
    begins = asked.select(F.col("question_id").alias("id"), "words").mapInArrow(_grams(sizes, True), "id long, gram long").withColumnRenamed("id", "question_id")
    docs = index.select("id", F.filter(F.split(F.col(column), " "), lambda w: w != "").alias("words"))
    pairs = docs.mapInArrow(_grams(sizes, False), "id long, gram long").join(begins, "gram").select("id", "question_id").distinct()
    pairs = pairs.join(phrases, "question_id").join(index.select("id", column), "id")
    return pairs.select("question_id", "id", occurrences(F.col(column), F.col("phrase")).cast("long").alias("tf")).where("tf > 0").distinct()


def retrieved(docs: DataFrame, text: str, questions: DataFrame, k: int = 15) -> DataFrame:
    """Each question's k documents (question_id, id, how, score, rank): those that hold it as a phrase, by
    occurrences, or, if none does, the most similar ones. A question without tokens has none."""
    hits = shared.staged(phrases_by_question(indexed(docs, text), f"w_{text}", questions), "hits")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("tf"), "id"))
    exact = hits.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "id", F.lit("phrase").alias("how"), F.col("tf").cast("double").alias("score"), "rank")
    others = questions.join(hits.select("question_id").distinct(), "question_id", "left_anti").select(F.col("question_id").alias("id"), "question")
    near = similar(vectors(docs, text), vectors(others, "question"), k)
    return exact.unionByName(near.select(F.col("query_id").alias("question_id"), "id", F.lit("similar").alias("how"), "score", "rank"))


def _weighted(dims: int):
    """Rows (id, tokens) as rows (id, slots, weights); a token is hashed once in a batch."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("tokens")), 0))
            lists, n = batch.column("tokens"), batch.num_rows
            said = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(n, dtype=np.int64), np.diff(lists.offsets.to_numpy()))
            low = np.array([int(hashlib.md5(w.encode()).hexdigest()[-3:], 16) for w in said.dictionary.to_pylist()], np.int64)
            key, tf = np.unique(row * max(1, len(low)) + said.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(key, max(1, len(low)))
            sign = np.where(low[code] >> 9 & 1, 1.0, -1.0)
            key, at = np.unique(row * dims + low[code] % dims, return_inverse=True)
            row, slot = np.divmod(key, dims)
            w = np.bincount(at, sign * (1 + np.log(tf)), len(key))
            norm = np.sqrt(np.bincount(row, w * w, n))
            ends = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            weight = w / np.where(norm == 0, 1.0, norm)[row]
            columns = [batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "slots", "weights"])

    return run


def vectors(docs: DataFrame, text: str, dims: int = 512) -> DataFrame:
    """(id, slots, weights) of unit length: signed 1 + ln(tf) by hashed token (`exprs.hash_slot`), of each id with tokens.

    Texts are exchanged, not their words; rows of one id count as one text.
    """
    shared.importable(docs.sparkSession)
    whole = docs.groupBy("id").agg(F.concat_ws("\n", F.collect_list(text)).alias("whole"))
    said = whole.select(F.col("id").cast("long").alias("id"), exprs.tokens(F.col("whole")).alias("tokens"))
    return said.mapInArrow(_weighted(dims), "id long, slots array<int>, weights array<double>")


def spread(vectors: DataFrame) -> DataFrame:
    """(id, slot, weight), a row for each slot of `vectors`."""
    rows = vectors.select("id", F.explode(F.arrays_zip("slots", "weights")).alias("x"))
    return rows.select("id", F.col("x.slots").alias("slot"), F.col("x.weights").alias("weight"))


def embedding(docs: DataFrame, text: str, dims: int = 512) -> DataFrame:
    """`vectors` as sparse rows (id, slot, weight)."""
    return spread(vectors(docs, text, dims))


def similar(vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """V1: the k documents nearest to each query, among those that share a slot with it; both as `vectors` or `embedding` gives them."""
    return nearest.sparse(vectors, queries, k)


def cosine(x: Column, y: Column) -> Column:
    """F8: dense cosine; 0 for unequal lengths, a zero norm divides by 1."""

    def norm(v: Column) -> Column:
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
        return F.when(n == 0, 1.0).otherwise(n)

    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)
    return F.when(F.size(x) != F.size(y), 0.0).otherwise(dot / (norm(x) * norm(y)))
