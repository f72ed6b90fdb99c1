"""Tables staged in the folder that the cluster shares (spark.checkpoint.dir): they cut a plan and fix what it numbered."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType


def folder(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        local = tempfile.mkdtemp(prefix="folioworks-")
        atexit.register(shutil.rmtree, local, True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def importable(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once: they needn't have it installed, nor see the driver's folders."""
    context = spark.sparkContext
    if getattr(context, "_folioworks_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="folioworks-")) / "folioworks.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._folioworks_sent = True
    atexit.register(shutil.rmtree, target.parent, True)


def place(spark: SparkSession, name: str) -> str:
    """A new path there."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Removes an execution's shuffle files when it ends, and not only when the driver's heap is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BRIEF: ContextVar[tuple[list, ...]] = ContextVar("brief", default=())


def _files(spark: SparkSession, path: str):
    """The folder's file system and path, as Hadoop has them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What plans that are made and run inside exchange is removed when they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _written(df: DataFrame, path: str) -> None:
    with cleaned(df.sparkSession):
        df.write.parquet(path)


@contextlib.contextmanager
def brief() -> Iterator[None]:
    """What is staged inside goes at the end, and not with the session: nothing read from it may be left to do."""
    inside: list = []
    mark = _BRIEF.set((*_BRIEF.get(), inside))
    try:
        yield
    finally:
        _BRIEF.reset(mark)
        for spark, path in inside:
            files, hadoop = _files(spark, path)
            files.delete(hadoop, True)


def staged(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df as written there and read again; it goes when the session ends, or the `brief` around it (`outer`: the one around that)."""
    spark = df.sparkSession
    path = place(spark, name)
    around = _BRIEF.get()[:-1] if outer else _BRIEF.get()
    if around:
        around[-1].append((spark, path))
    _written(df, path)
    files, hadoop = _files(spark, path)
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def staged_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The parts of one table, written there one after the other and read as one; they go when the session ends, whatever `brief` is around."""
    paths = []
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        if not paths:
            path = place(spark, name)
            files, hadoop = _files(spark, path)
        paths.append(f"{path}/{len(paths)}")
        _written(df, paths[-1])
        files.deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(*paths)


def staged_by(df: DataFrame, name: str, key: str, schema) -> DataFrame:
    """df written there in a folder for each value of the int column `key`, and read again with df's other columns' schema."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.partitionBy(key).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(StructType([*schema.fields, StructField(key, IntegerType())])).parquet(path)
