"""The archive's tables as DataFrames over the star schema's Parquet files.

Every property is a lazy plan; nothing is read until a query runs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.functions import exprs


def iso(c: str):
    return F.substring(F.col(c).cast("string"), 1, 10)


class Archive:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """One record page per order; urgent orders of a customer with several are pages of its group."""
        o = self.raw("orders")
        urgent = F.col("o_orderpriority") == "1-URGENT"
        mine = Window.partitionBy("o_custkey", urgent)
        grouped = urgent & (F.count("*").over(mine) >= 2)
        return o.select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
            F.when(F.col("o_orderstatus") != "P", iso("o_orderdate")).alias("date_depicted"),
            F.when(F.col("o_orderkey") % 10 != 0, iso("o_orderdate")).alias("date_range_start"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(F.col("o_orderpriority")).alias("source_archive"),
            (F.col("o_totalprice") > 400000).cast("int").alias("is_key_evidence"), (F.col("o_orderkey") % 17 == 0).cast("int").alias("is_trashed"),
            F.when(grouped, F.col("o_custkey")).alias("group_id"),
            F.when(grouped, F.row_number().over(mine.orderBy("o_orderkey"))).alias("page_number"),
            F.col("o_custkey").alias("custkey"),
        )

    @cached_property
    def described(self) -> DataFrame:
        """Documents with a file name, a title that can be missing, and a medium with its category."""
        six = F.col("id") % 6
        medium = F.when(six == 0, "Letter").when(six == 1, "Invoice").when(six == 3, "").when(six == 4, "photo").when(six == 5, "Poster")
        out = self.documents.withColumns({"own_title": F.when(F.col("id") % 13 != 0, F.col("title")), "filename": F.concat(F.lit("scan_"), "id", F.lit(".jpg")), "medium": medium})
        return out.withColumn("medium_category", exprs.medium_category(F.col("medium")))

    @cached_property
    def stamped(self) -> DataFrame:
        """Documents with created_at, and updated_at where they were changed."""
        made = self.raw("orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.when(F.col("o_orderkey") % 4 == 0, F.date_format(F.date_add("o_orderdate", (F.col("o_orderkey") % 90).cast("int")), "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, "").alias("updated_at"))
        return self.described.join(made, "id")

    @cached_property
    def stamped_groups(self) -> DataFrame:
        """Groups made with their first page and changed with their last changed one."""
        made = self.stamped.where("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
        return self.groups.join(made, "id")

    @cached_property
    def group_transactions(self) -> DataFrame:
        """Transactions that groups have of their own: those of their first pages."""
        first = self.documents.where("group_id is not null and page_number = 1").select(F.col("id").alias("document_id"), "group_id")
        return self.transactions.join(first, "document_id").drop("document_id")

    @cached_property
    def groups(self) -> DataFrame:
        g = self.documents.where("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.min("date_depicted").alias("date_depicted"), F.min_by("source_archive", "page_number").alias("source_archive"))
        return g.select("id", F.concat(F.lit("Group #"), "id").alias("title"), "date_depicted", F.lit(None).cast("string").alias("date_range_start"), "source_archive", (F.col("id") % 23 == 0).cast("int").alias("is_trashed"))

    @cached_property
    def standalone(self) -> DataFrame:
        """Live documents that aren't pages of a group."""
        return self.documents.where("is_trashed = 0 and group_id is null")

    @cached_property
    def live_groups(self) -> DataFrame:
        return self.groups.where("is_trashed = 0")

    @cached_property
    def entities(self) -> DataFrame:
        s, c, p, n = (self.raw(t) for t in ("supplier", "customer", "part", "nation"))
        kind = F.when(F.col("s_suppkey") % 2 == 0, "person").otherwise("institution")
        parts = [
            s.select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"), kind.alias("type")),
            c.select((F.col("c_custkey") + 2_000_000).alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("type")),
            p.select((F.col("p_partkey") + 3_000_000).alias("id"), F.col("p_name").alias("name"), F.lit("object").alias("type")),
            n.select((F.col("n_nationkey") + 4_000_000).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("place").alias("type")),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.withColumn("normalized_name", F.lower("name"))

    @cached_property
    def document_entities(self) -> DataFrame:
        """Distinct (document, entity, role)."""
        l, o, c = self.raw("lineitem"), self.raw("orders"), self.raw("customer")
        lines = l.select(F.col("l_orderkey").alias("document_id"), "l_suppkey", "l_partkey")
        with_lines = o.join(lines.select(F.col("document_id").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").join(c, F.col("o_custkey") == F.col("c_custkey"))

        def link(df, key, entity, role):
            return df.select(F.col(key).alias("document_id"), entity.cast("long").alias("entity_id"), F.lit(role).alias("role"))

        sold = link(lines, "document_id", F.col("l_suppkey") + 1_000_000, "seller").distinct()
        lots = link(lines, "document_id", F.col("l_partkey") + 3_000_000, "lot").distinct()
        bought = link(with_lines, "o_orderkey", F.col("o_custkey") + 2_000_000, "buyer")
        origin = link(with_lines, "o_orderkey", F.col("c_nationkey") + 4_000_000, "origin")
        return sold.unionByName(lots).unionByName(bought).unionByName(origin)

    @cached_property
    def group_entities(self) -> DataFrame:
        return self.groups.select(F.col("id").alias("group_id"), (F.col("id") + 2_000_000).alias("entity_id"), F.lit("owner").alias("role"))

    @cached_property
    def transactions(self) -> DataFrame:
        l, o, c, s, n = (self.raw(t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
        t = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        return t.select(
            F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") != "N", F.col("s_name")).alias("seller"), F.col("c_name").alias("buyer"),
            F.when(~((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 5)), iso("l_shipdate")).alias("date"),
            F.col("l_extendedprice").alias("price"), F.lit("USD").alias("currency"), F.when(F.col("l_returnflag") == "R", F.col("n_name")).alias("auction_house"),
            F.col("l_linenumber").cast("string").alias("lot_number"), F.col("l_suppkey").alias("suppkey"),
        )

    @cached_property
    def document_tags(self) -> DataFrame:
        l, p = self.raw("lineitem"), self.raw("part")
        return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("document_id"), F.col("p_type").alias("tag")).distinct()

    @cached_property
    def pages(self) -> DataFrame:
        """Files that an ingest finds: content hash, name, and what the archive knows of them."""
        p = self.raw("pages")
        known = F.when(F.col("page_id") % 9 == 0, "failed").when(F.col("page_id") % 3 == 0, "ingested")
        return p.select("page_id", "url", F.sha2("html", 256).alias("sha256"), known.alias("known"))

    @cached_property
    def audit(self) -> DataFrame:
        e = self.raw("events")
        status = F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "signup", "requeued").otherwise("ok")
        return e.select("event_id", F.col("ts").cast("string").alias("ts"), F.dayofmonth("ts").cast("long").alias("run_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("action"), status.alias("status"), "value", "props")
