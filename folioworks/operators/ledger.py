"""Ingest runs, audit trail and snapshot mutations (J10, J11, J18, A14, A15, A26, M-operators, W9).

A mutation takes tables and returns new ones; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import exprs


def pending(files: DataFrame) -> DataFrame:
    """Files to work on: new ones, and those whose last extraction failed."""
    hashes = files.where("known = 'ingested'").select("sha256").distinct()
    return files.where("known is null or known = 'failed'").join(hashes, "sha256", "left_anti").select("page_id", "sha256", F.when(F.col("known") == "failed", "requeue").otherwise("new").alias("action"))


def histogram(runs: DataFrame) -> DataFrame:
    """Files of each run and status."""
    return runs.groupBy("run_id", "status").agg(F.count("*").alias("files"))


def summary(runs: DataFrame) -> DataFrame:
    """Each run's counters and the share that went well."""
    out = runs.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("processed"), F.count_if(F.col("status") == "err").alias("errors"), F.count_if(F.col("status") == "requeued").alias("requeued"))
    return out.withColumn("percent", exprs.percent(F.col("processed"), F.col("total")))


def progress(runs: DataFrame) -> DataFrame:
    """Files done so far in each run, in order of arrival; summed by hours first, so that no task goes through a whole run."""
    good = F.col("status") == "ok"
    timed = runs.withColumn("hour", F.substring("ts", 1, 13))
    hours = timed.groupBy("run_id", "hour").agg(F.count("*").alias("n"), F.count_if(good).alias("g"))
    earlier = Window.partitionBy("run_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("run_id", "hour", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "ng"))
    so_far = Window.partitionBy("run_id", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = timed.withColumns({"done": F.count("*").over(so_far), "good": F.count_if(good).over(so_far)}).join(hours, ["run_id", "hour"])
    return out.withColumns({"done": F.col("done") + F.col("n_before"), "good": F.col("good") + F.col("g_before")}).select(*runs.columns, "done", "good")


def history(audit: DataFrame, *, entity_id: int | None = None, run_id: int | None = None, action: str | None = None, most: int = 1000) -> DataFrame:
    """The latest entries that meet all given tests, of which there must be one."""
    tests = {"entity_id": entity_id, "run_id": run_id, "action": action}
    given = {k: v for k, v in tests.items() if v is not None}
    if not given:
        raise ValueError("one of entity_id, run_id and action is needed")
    for k, v in given.items():
        audit = audit.where(F.col(k) == v)
    return audit.orderBy(F.desc("event_id")).limit(most)


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """M9: a row for each field that changed."""
    b, a = before.select(key, *(F.col(f).alias(f"old_{f}") for f in fields)), after.select(key, *(F.col(f).alias(f"new_{f}") for f in fields))
    both = b.join(a, key)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), exprs.audit_value(f, F.col(f"old_{f}")).alias("old_value"), exprs.audit_value(f, F.col(f"new_{f}")).alias("new_value")) for f in fields))
    return both.select(key, F.explode(rows).alias("c")).select(key, "c.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def patched(df: DataFrame, where: Column, values: dict[str, Column], allowed: tuple[str, ...]) -> DataFrame:
    """New values where the test holds, for allowed fields alone."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items() if c in allowed})


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """M5, M6: the last row of each key wins."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last")).select(*key, "last.*")


def cascaded(documents: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents without the gone ones, and every child table without theirs."""
    ids = gone.select(F.col("id").alias("document_id")).distinct()
    return documents.join(gone.select("id"), "id", "left_anti"), {k: v.join(ids, "document_id", "left_anti") for k, v in children.items()}


#: Fields that an extraction fills and a wipe empties.
DESCRIBED = ("date_depicted", "date_range_start", "date_range_end", "location", "medium", "dimensions", "language", "transcription", "raw_extraction")


def wiped(documents: DataFrame, where: Column) -> DataFrame:
    """Of the documents that pass, what an extraction filled is emptied, the title is the file's name, no evidence is key, and
    a marker has the next ingest take them again. Other documents, and what users added, stay as they are."""
    have = documents.columns
    new = {c: F.lit(None).cast(documents.schema[c].dataType) for c in DESCRIBED if c in have}
    if "title" in have and "filename" in have:
        new["title"] = F.col("filename")
    if "is_key_evidence" in have:
        new["is_key_evidence"] = F.lit(0)
    out = documents if "description" in have else documents.withColumn("description", F.lit(None).cast("string"))
    new["description"] = F.lit("Extraction failed: metadata wiped")
    return out.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def weak(transactions: DataFrame, least: int) -> DataFrame:
    """Transactions with a score, and whether a purge takes them."""
    score = exprs.transaction_score(*(F.col(c) for c in ("seller", "buyer", "date", "price", "auction_house")))
    return transactions.withColumn("score", score).withColumn("weak", F.lit(least > 0) & (F.col("score") < least))


def insert_or_ignore(links: DataFrame, new: DataFrame, key: list[str], nullable: str | None = None) -> DataFrame:
    """M4: new rows whose key isn't there; a NULL in the nullable part never collides."""
    if nullable is None:
        return links.unionByName(new.dropDuplicates(key).join(links.select(*key), key, "left_anti"))
    full, none = new.where(F.col(nullable).isNotNull()), new.where(F.col(nullable).isNull())
    return links.unionByName(full.dropDuplicates(key).join(links.select(*key), key, "left_anti").select(*links.columns)).unionByName(none)


def purged(transactions: DataFrame, least: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Transactions that stay, and an audit row for each that goes."""
    marked = weak(transactions, least)
    text = F.to_json(F.struct("seller", "buyer", "date", "price", "auction_house", "lot_number"))
    audit = marked.where("weak").select(F.lit("transaction").alias("entity_type"), F.col(key).alias("entity_id"), F.lit("purge").alias("action"), "score", text.alias("old_value"))
    return marked.where("not weak").drop("weak", "score"), audit


def swept(entities: DataFrame, *links: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Entities that some link still names; `also`: columns that a link and its entity must share beside the id."""
    used = links[0].select("entity_id", *also)
    for x in links[1:]:
        used = used.union(x.select("entity_id", *also))
    return entities.join(used.withColumnRenamed("entity_id", "id"), ["id", *also], "left_semi")
