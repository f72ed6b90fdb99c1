"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns
of documents, for the rows that it keeps. SQL can't express them; tests/llm checks line dedup,
near dedup, decontamination and packing against brute-force versions, and toxicity by what its
lexicon accepts.

Nulls, empty texts, ties and repeated rows: a null doc_id counts as the smallest id and a null
text as an empty one (see folioworks.llm.common); they score as clean, share no line, are one
group of near copies, hold no passage and pack as the end id alone. Rows that repeat doc_id and
text are scored, deduplicated and searched alike, and one of them stays after near dedup. Extra
columns of any name go through unchanged. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import common, decontamination, line_dedup, near_dedup, packing, toxicity

#: Near duplicates of a stage: shingles of five words, similarity 0.8 or more; at that
#: similarity a pair shares no band with a probability of about 1e-7.
SHINGLE, PERCENT, BANDS = 5, 80, 40


def _named(docs: DataFrame, columns: dict | None = None) -> list:
    """docs' own columns, some of them replaced."""
    return [(columns or {}).get(c, F.col(common.quoted(c))).alias(c) for c in docs.columns]


def _one_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each doc_id and text, any of them; a null doc_id counts as an id, a null text as empty."""
    names = common.fresh(docs, "row_k", "row_h")
    return docs.select("*", *(x.alias(n) for x, n in zip(common.row_keys(docs), names))).dropDuplicates(names).select(*_named(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, doesn't reject."""
    return toxicity.acceptable(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; one with nothing left stays, empty."""
    kept = line_dedup.line_dedup(docs).where("n_removed > 0").dropDuplicates(["k", "h"]).select("k", "h", "kept_text")
    new = F.col(common.fresh(docs, *kept.columns)[2])
    both = common.matched(docs, kept, "left")
    return both.select(*_named(docs, {"text": F.coalesce(new, F.col("text")), "n_chars": F.coalesce(F.length(new).cast("long"), F.col("n_chars"))}))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies; documents without words are one group."""
    found = near_dedup.near_duplicates(docs, SHINGLE, PERCENT, BANDS)
    found = common.staged(found, "near-copies")
    kept = found.where("n_shingles > 0 and k = root_k and h = root_h").select("k", "h")
    blank = found.where("n_shingles = 0").agg(F.min(F.struct("k", "h")).alias("one")).where("one is not null").select("one.k", "one.h")
    return common.matched(_one_each(docs), kept.union(blank).distinct(), "left_semi").select(*_named(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the learned lexicon, patience diff, sketches, alignments or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; what each but the last returns is staged as Parquet."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
