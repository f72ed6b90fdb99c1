"""Files as a source (S1, S2): a folder's images with their content hashes, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import exprs

# Suffixes of the files that an ingest takes.
SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")


def hashed(files: DataFrame) -> DataFrame:
    """Name, suffix, media type and SHA-256 of files read with their content."""
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("filename"), exprs.suffix(name).alias("suffix"), F.sha2("content", 256).alias("sha256"), "length")
    return out.where(F.col("suffix").isin(*SUFFIXES)).withColumn("media_type", exprs.media_type(F.col("filename")))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    return hashed(spark.read.format("binaryFile").load(folder))


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return hashed(spark.readStream.format("binaryFile").schema(schema).load(folder))
