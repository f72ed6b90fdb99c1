"""Place names: gazetteer and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions import exprs


def gazetteer(records: DataFrame, least: int = 2) -> DataFrame:
    """Places that at least so many records name, with the first written form."""
    named = records.select("id", F.explode(exprs.places(F.col("location"))).alias("place")).withColumn("norm", exprs.normalized_name(F.col("place")))
    return named.groupBy("norm").agg(F.min_by("place", "id").alias("display"), F.countDistinct("id").alias("records")).where(F.col("records") >= least)


def mentions(docs: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """(id, term) for every term of one or more words that a text holds as words.

    Texts and terms meet on the words in sequence: a text's runs of as many words as some term has, each once, so
    what is exchanged is the text times the number of term lengths.
    """
    wanted = terms.select("term", exprs.words(F.col("term")).alias("t")).select("term", F.size("t").alias("size"), F.array_join("t", " ").alias("run")).where("size > 0")
    words = docs.select("id", exprs.words(F.col(column)).alias("w"))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # a row for each length of a term
    found = None

    def in_sequence(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    for n in sizes:
        runs = in_sequence(n) if n > 1 else F.col("w")
        each = words.where(F.size("w") >= n).select("id", F.explode(F.array_distinct(runs)).alias("run"))
        part = each.join(wanted.where(F.col("size") == n), "run").select("id", "term")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select("id").crossJoin(terms.select("term")).limit(0)
    return found.distinct()
