"""Streaming ingest: events as progress, and content-addressed files taken once (K1-K4, K8)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.sources import lease, log, shared
from folioworks.sources.lease import Lease
from folioworks.sources.versions import Table


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files as a stream, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}*")


def windowed_progress(events: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """K4, K8: events by window and type; late rows within the watermark count."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("events"))


def collected(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream of aggregates over what is there and returns each key's latest row.

    Every batch appends the rows that it changed to a table in the shared folder, under its number;
    a batch that is run again gives the same rows, so the latest ones stay right.
    """
    spark, path = stream.sparkSession, shared.place(stream.sparkSession, "progress")
    spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long")).write.parquet(path)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    run = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", shared.place(spark, "checkpoint"))
    run.trigger(availableNow=True).start().awaitTermination()
    others = [c for c in stream.columns if c not in keys]
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")


def ingest_once(files: DataFrame, archive: str, checkpoint: str, hash_column: str = "sha256") -> None:
    """K1, K3: appends files whose content the archive hasn't got; a repeated run or batch adds nothing.

    A batch's rows are compared with the archive itself, so no state grows with it, and a
    batch that is run again after a failure finds its own rows there. The archive lies in folders of the
    hashes' first two characters, so a small batch reads a small part of its hashes.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([hash_column]).withColumn("prefix", _prefix(F.col(hash_column)))
        if log.there(spark, archive):
            prefixes = [r[0] for r in new.select("prefix").distinct().collect()]  # 256 of a hexadecimal hash at most
            there = spark.read.schema(new.schema).parquet(archive).where(F.col("prefix").isin(*prefixes))
            new = new.join(there.select("prefix", hash_column), ["prefix", hash_column], "left_anti").select(*new.columns)
        new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(archive)

    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _prefix(hash_: Column) -> Column:
    return F.left(hash_, F.lit(2))


def take(files: DataFrame, archive: Table, fence: int, hash_column: str = "sha256") -> int:
    """K1, K3: appends files whose content the archive hasn't got, under a lease's number; returns how many.

    Hashes are compared within the prefixes that the files have, so a small batch reads a small part of the archive's.
    """
    new = files.dropDuplicates([hash_column]).withColumn("prefix", _prefix(F.col(hash_column)))
    prefixes = [r[0] for r in new.select("prefix").distinct().collect()]  # 256 of a hexadecimal hash at most
    there = archive.read()
    if len(prefixes) < 200:
        there = there.where(F.col("prefix").isin(*prefixes))
    new = shared.staged(new.join(there.select("prefix", hash_column), ["prefix", hash_column], "left_anti"), "new")
    archive.append(new.repartitionByRange("prefix").sortWithinPartitions("prefix"), fence)
    return new.count()


def exclusive(spark: SparkSession, path: str, holder: str, work: Callable[[Table, Lease], int], schema, seconds: float = 600.0, clock: Callable[[], float] = time.time) -> dict:
    """K1: runs work(archive, lease) if no other ingest into `path` is running: {status: started or busy, taken}.

    work should renew the lease while it lasts; what it appends after another holder has come is refused.
    """
    held = lease.acquire(spark, f"{path}/lease", holder, seconds, clock)
    if held is None:
        return {"status": "busy", "taken": 0}
    archive = Table(spark, f"{path}/archive", schema)
    try:
        archive.barrier(held.fence)
        return {"status": "started", "taken": work(archive, held)}
    finally:
        held.release()
