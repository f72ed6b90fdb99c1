"""What the operators share: tables, keys and tables staged in the cluster's shared folder.

Rows are keyed by ``doc_id``. A null ``doc_id`` is the smallest key and stays null
in results; a null text counts as empty; rows that repeat a ``doc_id`` are kept as
rows of their own and told apart by a hash of their text, so equal rows get equal results.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of a null doc_id: below every id that the tables hold.
NULL_KEY = -(2**63)


#: While a table is staged: Spark drops the shuffle files of the written query once it is done.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver does."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns k (long), h (hash of the text) and text; no nulls."""
    importable(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def doc_id(key: str = "k") -> Column:
    return F.nullif(F.col(key), F.lit(NULL_KEY)).alias("doc_id")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no column of any such name."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(mark + n.lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def row_keys(df: DataFrame) -> list[Column]:
    """k and h of df's rows, as `keyed` has them."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)), F.xxhash64(F.coalesce("text", F.lit("")))]


def matched(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """docs joined by its rows' keys with other's k and h; other's columns get names that docs hasn't got (see `fresh`)."""
    names = dict(zip(other.columns, fresh(docs, *other.columns)))
    k, h = row_keys(docs)
    return docs.join(other.withColumnsRenamed(names), (k == F.col(names["k"])) & (h == F.col(names["h"])), how)


#: A key that holds more than one of so many equal shares of a join's rows, and more than so many rows, is dealt over several tasks.
SHARES, ROWS = 1000, 256


def heavy_keys(counts: DataFrame, on: str, parts: str, n: str = "n") -> DataFrame:
    """The keys `on` whose n rows are over a share of all that counts has, and in how many parts they are to be dealt.

    Fewer than SHARES keys can be so frequent, whatever the table holds, so the result can be broadcast.
    counts is read more than once: pass a staged table.
    """
    share = max(ROWS, -(-(counts.agg(F.sum(n)).first()[0] or 0) // SHARES))
    return F.broadcast(staged(counts.where(F.col(n) > share).select(on, F.ceil(F.col(n) / share).cast("int").alias(parts)), "heavy"))


def spread_join(rows: DataFrame, other: DataFrame, on: str, by: str, counts: DataFrame, n: str = "n") -> DataFrame:
    """Inner join of rows with other, whose keys `on` may be as frequent as they like in rows.

    counts: n, the number of rows, for each key that other has, as `heavy_keys` takes it. A frequent key's rows are
    dealt by a hash of `by` over as many tasks as it has parts, each with a copy of other's row.
    """
    salt, parts = fresh(rows.select("*", *(F.lit(0).alias(c) for c in other.columns if c != on)), "salt", "parts")
    heavy = heavy_keys(counts, on, parts, n)
    many = F.coalesce(parts, F.lit(1))
    left = rows.join(heavy, on, "left").withColumn(salt, F.pmod(F.xxhash64(by), many).cast("int"))
    right = other.join(heavy, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1)))
    return left.drop(parts).join(right.drop(parts), [on, salt]).drop(salt)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        local = tempfile.mkdtemp(prefix="folioworks-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
