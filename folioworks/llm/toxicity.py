"""Op 8, toxicity by a weighted lexicon that labelled documents teach.

Texts are folded (lower case, accents, look-alike letters, digits and signs that stand for
letters). The lexicon holds word beginnings and whole words that toxic training documents
have far more often than others, each weighted by its log odds; phrases of a lexicon word
and a neighbour that clean documents have as readily are exceptions and silence it. An
Aho-Corasick automaton finds them all in one pass; the weights found, and their sum
normalised by the text's length, go through a logistic curve fitted to the same documents.

Training takes about TRAINING labelled documents at most, chosen by a hash of doc_id at a rate
that their count gives, one text of each doc_id; rows whose crc32(doc_id as text) mod 4 is 2
are held out. All entries and exceptions that meet the thresholds below are used; their number
is bounded by the training documents. Labels, lang, source and doc_id are no inputs of a score.
Results: null and empty texts get the score of no match; a null doc_id is not held out and has no
label; a label of a doc_id that repeats counts by its largest; rows that repeat a doc_id are
scored each; texts are scored whole; other columns are ignored; an empty table gives an empty
result; without labels of both kinds, scores are 0.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.llm import textkit as tk

TRAINING = 20_000
HELD_OUT = 2
THRESHOLD = 0.3
#: Lengths of word beginnings that can be lexicon entries.
STEMS = (4, 5, 6, 7)
#: An entry has been in so large a share of the toxic documents, between LEAST_DOCS of them, and its share of their words is so many times that of clean ones.
SHARE, LEAST_DOCS, LEAST_ODDS = 0.1, (3, 8), 5.0
#: A phrase is an exception if so many clean documents have it and it is no likelier in toxic ones.
EXCEPTION_DOCS = 5

# Characters that stand for letters.
_STANDS_FOR = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e",
    "а": "a", "в": "b", "е": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}


def _folding() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for n in [*range(0x3000), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)]:
        if 0xD800 <= n < 0xE000:
            continue
        c = unicodedata.normalize("NFKD", chr(n)).casefold()[:1] or chr(n)
        out[n] = ord(_STANDS_FOR.get(c, c))
    return out


_FOLD: list[np.ndarray] = []


def fold(text: str) -> str:
    """Folded text of the same length."""
    if not _FOLD:
        table = _folding()
        letter = np.zeros(len(table), bool)
        letter[:0x3000] = [chr(n).isalpha() for n in range(0x3000)]
        _FOLD.extend((table, letter))
    return _FOLD[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype("<u4").tobytes().decode("utf-32-le")


def _letters(folded: str) -> np.ndarray:
    return _FOLD[1][np.frombuffer(folded.encode("utf-32-le"), np.uint32)]


def word_list(folded: str) -> list[str]:
    mask = np.concatenate([[False], _letters(folded), [False]])
    edge = np.flatnonzero(mask[1:] != mask[:-1]).tolist()
    return [folded[i:j] for i, j in zip(edge[::2], edge[1::2])]


def _families(batches):
    """Each document's least shingle: near copies mostly share it, others don't."""
    for batch in batches:
        for b in tk.blocks(batch.column("text")):
            w = tk.words(b.data, b.off)
            at, gram = tk.grams(tk.span_hash(b.data, w.start, w.end), w.first, 3)
            edge = np.searchsorted(at, w.first)
            least = [int(gram[i:j].min()) >> 1 if j > i else -1 - n for n, (i, j) in enumerate(zip(edge, edge[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(c)[b.rows] for c in ("k", "text", "toxic")] + [pa.array(least, pa.int64())], ["k", "text", "toxic", "family"])


def _training(batches):
    """How often each training document has each feature: |word| whole, word beginnings with |; and || for all words."""
    for batch in batches:
        rows, names, counts, toxic = [], [], [], batch.column("toxic").to_pylist()
        for n, text in enumerate(batch.column("text").to_pylist()):
            words = Counter(word_list(fold(text)))
            mine: Counter = Counter({"||": sum(words.values())})
            for w, c in words.items():
                c = c.bit_length()  # many repeats in one document say little more
                mine[f"|{w}|"] += c
                for size in STEMS:
                    if len(w) > size:
                        mine[f"|{w[:size]}"] += c
            names += mine
            counts += mine.values()
            rows += [toxic[n]] * len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.int32()), pa.array(counts, pa.int64())], ["name", "toxic", "times"])


def _pairs(entries: dict[str, float]):
    def run(batches):
        for batch in batches:
            rows, names, toxic = [], [], batch.column("toxic").to_pylist()
            for n, text in enumerate(batch.column("text").to_pylist()):
                words = word_list(fold(text))
                own = [any(f"|{w}|"[:size] in entries for size in range(2, len(w) + 3)) for w in words]
                mine = {f"|{x} {y}|" for i, (x, y) in enumerate(zip(words, words[1:])) if own[i] or own[i + 1]}
                names += mine
                rows += [toxic[n]] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.int32()), pa.array([1] * len(rows), pa.int64())], ["name", "toxic", "times"])

    return run


class Matcher:
    """Counts lexicon entries in blocks of texts: of each text the matches, their weight, and its words."""

    def __init__(self, entries: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for name, weight in entries.items():
            self.automaton.add_word(name.strip("|"), (len(name.strip("|")), name.endswith("|"), weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase.strip("|"), (len(phrase.strip("|")), True, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def count(self, texts: list[str]) -> np.ndarray:
        whole = fold("\n".join(texts))
        letters = np.concatenate([[False], _letters(whole), [False]])
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        starts = np.flatnonzero(letters[1:-1] & ~letters[:-2])
        out = np.zeros((len(texts), 3))
        out[:, 2] = np.diff(np.searchsorted(starts, begin))
        best: dict[int, tuple[int, float]] = {}
        quiet: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (size, closed, weight) in self.automaton.iter(whole):
                at = end - size + 1
                if letters[at] or closed and letters[end + 2]:  # inside a word, or the word goes on
                    continue
                if weight is None:
                    quiet.append((at, end))
                elif size > best.get(at, (0, 0.0))[0]:
                    best[at] = (size, weight)
        for at, end in quiet:
            for i in [i for i in range(at, end + 1) if i in best]:
                del best[i]
        edges = begin.tolist()
        for at, (_, weight) in best.items():
            row = bisect_right(edges, at) - 1
            out[row, 0] += 1
            out[row, 1] += weight
        return out


def _signals(counts: np.ndarray) -> np.ndarray:
    """Constant, and logs of the weight found, of the weight for each hundred words and of the matches."""
    return np.stack([np.ones(len(counts)), np.log1p(counts[:, 1]), np.log1p(100 * counts[:, 1] / (20 + counts[:, 2])), np.log1p(counts[:, 0])], 1)


def _counted(entries: dict[str, float], exceptions: list[str], curve: list[float] | None):
    def run(batches):
        matcher = Matcher(entries, exceptions)
        for batch in batches:
            for b in tk.blocks(batch.column("text")):
                got = matcher.count(batch.column("text")[b.rows].to_pylist())
                if curve is None:
                    toxic = batch.column("toxic")[b.rows]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in _signals(got).T), toxic], ["x0", "x1", "x2", "x3", "toxic"])
                else:
                    score = 1 / (1 + np.exp(-np.clip(_signals(got) @ np.array(curve), -30, 30)))
                    yield pa.RecordBatch.from_arrays([batch.column("k")[b.rows], batch.column("h")[b.rows], pa.array(score)], ["k", "h", "score"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str = "k") -> Column:
    return (F.col(key) != common.NULL_KEY) & (F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == HELD_OUT)


class Model:
    def __init__(self, entries: dict[str, float], exceptions: list[str], curve: list[float]):
        self.entries, self.exceptions, self.curve = entries, exceptions, curve


def _by_name(features: DataFrame) -> DataFrame:
    """Of each feature: toxic documents and how often it is in toxic and in clean ones."""
    bad = F.col("toxic") == 1
    return features.groupBy("name").agg(F.count_if(bad).alias("docs"), F.sum(F.when(bad, F.col("times")).otherwise(0)).alias("bad"), F.sum(F.when(~bad, F.col("times")).otherwise(0)).alias("good"))


def _odds(n: tuple[int, int]) -> Column:
    return F.log((F.col("bad") + 0.5) / (n[0] + 1)) - F.log((F.col("good") + 0.5) / (n[1] + 1))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING) -> Model:
    """A model of about `rows` labelled documents at most that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("k"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("k").agg(F.max("toxic").alias("toxic"))
    rate = rows / max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / float(1 << 40) < rate)  # about `rows` rows of two numbers
    train = common.keyed(docs).join(F.broadcast(chosen), "k").groupBy("k").agg(F.min_by(F.struct("text", "toxic"), "h").alias("one"))
    train = train.select("k", "one.*").mapInArrow(_families, "k long, text string, toxic int, family long")
    train = train.groupBy("family", F.when(F.col("family") < 0, F.col("k")).alias("own")).agg(F.min_by(F.struct("text", "toxic"), "k").alias("one")).select("one.*")
    train = common.staged(train, "labelled")
    kinds = dict(train.groupBy("toxic").count().collect())
    if not kinds.get(0) or not kinds.get(1):
        return Model({}, [], [-30.0, 0.0, 0.0, 0.0])
    named = common.staged(_by_name(train.mapInArrow(_training, "name string, toxic int, times long")), "features")
    total = named.where("name = '||'").first()
    named = named.withColumn("odds", _odds((total["bad"], total["good"]))).where("name <> '||'")
    least = min(LEAST_DOCS[1], max(LEAST_DOCS[0], int(SHARE * kinds[1])))
    named = named.where((F.col("docs") >= least) & (F.col("odds") >= float(np.log(LEAST_ODDS))))
    top = named.select("name", "odds").collect()  # words of several training documents
    entries: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r["name"]), r["name"])):
        word = r["name"].strip("|")
        inside = [entries.get(f"|{word[:size]}") for size in STEMS]
        if not any(x is not None and x >= r["odds"] - 1.5 for x in inside):
            entries[r["name"]] = float(r["odds"])
    pairs = _by_name(train.mapInArrow(_pairs(entries), "name string, toxic int, times long")).withColumn("odds", _odds((kinds[1], kinds[0])))
    exceptions = [r["name"] for r in pairs.where((F.col("good") >= EXCEPTION_DOCS) & (F.col("odds") <= 0)).select("name").collect()]
    seen = train.mapInArrow(_counted(entries, exceptions, None), "x0 double, x1 double, x2 double, x3 double, toxic int").toPandas()  # a row of five numbers for each training document
    curve = logistic(seen[["x0", "x1", "x2", "x3"]].to_numpy(), seen["toxic"].to_numpy(), 1.0)
    return Model(entries, exceptions, curve.tolist())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """k, h, score of each row of docs."""
    return common.keyed(docs).mapInArrow(_counted(model.entries, model.exceptions, model.curve), "k long, h long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    return out.select(common.doc_id(), held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def acceptable(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; scored where they stand, without an exchange."""
    common.importable(docs.sparkSession)
    fields = [f.name for f in docs.schema.fields]

    def run(batches):
        matcher, curve = Matcher(model.entries, model.exceptions), np.array(model.curve)
        for batch in batches:
            for b in tk.blocks(batch.column("text")):
                texts = [x or "" for x in batch.column("text")[b.rows].to_pylist()]
                score = 1 / (1 + np.exp(-np.clip(_signals(matcher.count(texts)) @ curve, -30, 30)))
                yield batch.slice(b.rows.start, b.rows.stop - b.rows.start).select(fields).filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
