"""Op 6, balanced sharding by label propagation; DataFrame operations only.

Documents with equal texts are linked. Each starts in a shard given by a hash of its id.
In each round a linked document wants the shard that holds most of its group, of those that
still have room; wishes are granted by a hash of the document up to the share of each
shard's room, so quotas hold without ranking a group. Unlinked documents make room. In the
end whole counts are evened out: each shard keeps its first documents, linked ones first,
and the rest fill the shards that have too few. Law `rows`: counts differ by one at most.

Ranks are running counts over (shard, slice) tables of bounded slices, so no shard is sorted
in one task. Results: a null text has size 1 and the checksum of an empty text, and belongs
to the group of empty texts; rows that repeat a doc_id are documents of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm import common

SHARDS = 16
ROUNDS = 4
#: Rows of a slice that is ranked in one task.
SLICE = 20_000


def _uniform(*columns: str) -> Column:
    """A hash of the row in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / float(1 << 52)


def _ranked(df: DataFrame, by: str | None, slices: int, first: Column, name: str) -> DataFrame:
    """Numbers the rows of each `by` from 0, those with `first` before the others, then by a hash."""
    slice_ = F.when(first, 0).otherwise(slices) + F.floor(F.col("u") * slices).cast("long")
    df = df.withColumn("slice", slice_.cast("long")).withColumn("by", F.col(by) if by else F.lit(0))
    sums = df.groupBy("by", "slice").agg(F.count("*").alias("c"))
    before = sums.withColumn("before", F.sum("c").over(Window.partitionBy("by").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("by", "slice").orderBy("u", "k", "h", "copy")) - 1
    out = df.withColumn("inside", inside).join(before.select("by", "slice", "before"), ["by", "slice"])
    return out.withColumn(name, (F.coalesce("before", F.lit(0)) + F.col("inside")).cast("long")).drop("slice", "by", "inside", "before")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law `rows` says nothing of more shards)."""
    base = common.keyed(docs).select("k", "h", F.octet_length("text").alias("bytes"), F.crc32("text").alias("text_crc32"), F.md5("text").alias("group"))
    base = base.withColumn("copy", F.monotonically_increasing_id())
    base = base.withColumn("u", _uniform("k", "h", "copy")).withColumn("shard", F.floor(_uniform("copy", "h", "k") * shards).cast("int"))
    base = common.staged(base, "to-shard")
    total = base.count()
    slices = max(1, -(-total // (SLICE * shards)))
    groups = common.staged(base.groupBy("group").agg(F.count("*").alias("n")), "groups")
    at = common.spread_join(base, groups, "group", "copy", groups).withColumn("linked", F.col("n") > 1).drop("n")
    at = at.join(common.heavy_keys(groups, "group", "parts"), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    at = common.staged(at.withColumn("part", F.pmod(F.xxhash64("copy"), "parts").cast("int")), "linked")
    single, at = at.where("not linked"), at.where("linked")
    quota = total / shards

    def for_parts(df):
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    for _ in range(rounds):
        # one row per shard: the room that linked documents leave; a fixed number of rows
        held = dict(at.groupBy("shard").count().collect())
        room = [max(0.0, quota - held.get(s, 0)) for s in range(shards)]
        open_ = F.broadcast(base.sparkSession.createDataFrame([(s, room[s]) for s in range(shards)], "shard int, room double"))
        counts = at.groupBy("group", "shard", "parts").count()
        wish = counts.join(open_.where("room >= 1"), "shard").groupBy("group").agg(F.max_by("shard", F.struct("count", "room", -F.col("shard"))).alias("wish"), F.max("count").alias("most"), F.any_value("parts").alias("parts"))
        wish, here = for_parts(wish), for_parts(counts).withColumnRenamed("count", "here")
        asked = at.join(wish, ["group", "part"]).join(here, ["group", "part", "shard"]).where("wish <> shard and here <= most")
        demand = dict(asked.groupBy("wish").count().collect())
        if not demand:
            break
        share = F.broadcast(base.sparkSession.createDataFrame([(s, min(1.0, room[s] / demand[s])) for s in demand], "wish int, share double"))
        moved = at.join(wish, ["group", "part"], "left").join(here, ["group", "part", "shard"]).join(share, "wish", "left")
        go = F.coalesce((F.col("wish") != F.col("shard")) & (F.col("here") <= F.col("most")) & (F.col("u") < F.col("share")), F.lit(False))
        at = common.staged(moved.withColumn("shard", F.when(go, F.col("wish")).otherwise(F.col("shard"))).select(*at.columns), "moved")
    placed = _ranked(at.unionByName(single.select(*at.columns)), "shard", slices, F.col("linked"), "rank")
    placed = common.staged(placed, "ranked")
    held = dict(placed.groupBy("shard").count().collect())
    size = [total // shards + (s < total % shards) for s in range(shards)]
    keep = F.element_at(F.array(*map(F.lit, size)), F.col("shard") + 1)
    over = _ranked(placed.where(F.col("rank") >= keep), None, slices, F.col("linked"), "number")
    # the numbers of each shard that has too few, one after another
    target, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        lack = max(0, size[s] - held.get(s, 0))
        here = (F.col("number") >= start) & (F.col("number") < start + lack)
        target = F.when(here, s).otherwise(target)
        slot = F.when(here, F.col("number") - start + held.get(s, 0)).otherwise(slot)
        start += lack
    stay = placed.where(F.col("rank") < keep).select("k", "bytes", "text_crc32", "shard", F.col("rank").alias("slot"))
    out = stay.unionByName(over.select("k", "bytes", "text_crc32", target.alias("shard"), slot.alias("slot")))
    return out.select(
        common.doc_id(), (F.col("bytes") + 1).cast("long").alias("size"), F.col("text_crc32").cast("long"), F.lit("rows").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
