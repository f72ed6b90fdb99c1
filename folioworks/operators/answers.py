"""What a question is answered from, and tools' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_RECORDS, NO_TRANSACTIONS = "No documents.", "No transactions recorded."


def _line(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown")))


def record_block(kind: Column) -> Column:
    """a record's lines; columns id, title, date, location, description, annotation."""
    head = F.concat(F.lit("[Doc #"), "id", F.lit("] "), F.when(kind == "group", "(multi-page group) ").otherwise(""), F.coalesce("title", F.lit("Untitled")))
    note = F.concat(F.lit("Researcher note: "), F.nullif(F.col("annotation"), F.lit("")))
    return F.concat_ws("\n", head, _line("Date", F.col("date")), _line("Location", F.col("location")), F.concat(F.lit("Description: "), F.coalesce("description", F.lit(""))), note)


def transaction_line() -> Column:
    """columns id, date, seller, buyer, price (string), currency, auction_house, lot_number, location, notes."""

    def part(name: str, c: str, more: Column | None = None) -> Column:
        value = F.nullif(F.col(c), F.lit(""))
        return F.concat(F.lit(f"{name}: "), value, more) if more is not None else F.concat(F.lit(f"{name}: "), value)

    return F.concat_ws(" | ", F.concat(F.lit("[Doc #"), "id", F.lit("]")), part("Date", "date"), part("Seller", "seller"), part("Buyer", "buyer"),
                       part("Price", "price", F.concat(F.lit(" "), F.coalesce("currency", F.lit("")))), part("Auction", "auction_house", F.concat(F.lit(" lot "), F.coalesce("lot_number", F.lit("")))),
                       part("Location", "location"), part("Notes", "notes"))


def contexts(hits: DataFrame, records: DataFrame, transactions: DataFrame) -> DataFrame:
    """(question_id, records, transactions): the blocks of each question's records, documents before groups and in order of
    rank, and the lines of their transactions by date.

    hits: question_id, kind, id, rank; records: kind, id, title, ...; transactions: kind, id, date, seller, ...
    """
    first = F.when(F.col("kind") == "document", 0).otherwise(1)
    blocks = hits.join(records, ["kind", "id"]).select("question_id", first.alias("first"), "rank", record_block(F.col("kind")).alias("said"))
    lines = hits.select("question_id", "kind", "id").join(transactions, ["kind", "id"]).select("question_id", first.alias("first"), "date", transaction_line().alias("said"))

    def joined(rows: DataFrame, order: tuple[str, ...], between: str, name: str) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct(*order, "said")))
        return rows.groupBy("question_id").agg(F.array_join(F.transform(each, lambda x: x["said"]), between).alias(name))

    out = hits.select("question_id").distinct()
    out = out.join(joined(blocks, ("first", "rank"), "\n\n", "records"), "question_id", "left").join(joined(lines, ("first", "date"), "\n", "transactions"), "question_id", "left")
    return out.select("question_id", F.coalesce("records", F.lit(NO_RECORDS)).alias("records"), F.coalesce("transactions", F.lit(NO_TRANSACTIONS)).alias("transactions"))


def found_text(found: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """One row, the text of a search's result (id, title, date, snippet, place from 1): at most 50 records are named."""
    limit = min(limit, 50)
    line = F.concat(F.lit("• [Doc #"), "id", F.lit("] "), F.coalesce("title", F.lit("Untitled")), F.lit(" ("), F.coalesce(F.nullif("date", F.lit("")), F.lit("date unknown")), F.lit(")"), F.coalesce(F.concat(F.lit("\n  …"), F.nullif("snippet", F.lit("")), F.lit("…")), F.lit("")))
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= limit, F.struct("place", line.alias("line")))))
    one = found.agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("Found "), "n", F.lit(f" document(s) matching '{query}':\n\n"), "lines")
    return one.select(F.when(F.col("n") == 0, f"No documents found matching '{query}'.").otherwise(head).alias("text"))


def answer_text(answer: Column, confidence: Column, sources: Column) -> Column:
    """An answer with its confidence and the ids it is from."""
    ids = F.array_join(F.transform(sources, lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ")
    return F.concat(answer, F.lit("\n\n**Confidence:** "), confidence, F.lit("\n**Source documents:** "), ids)


def entity_text(entity: DataFrame, appearances: DataFrame, companions: DataFrame) -> DataFrame:
    """(id, text) of entities (id, name, type): their first 30 records by date and their 10 most frequent companions.

    appearances: entity_id, document_id, title, date, role; companions: entity_id, name, type, shared, place.
    """
    line = F.concat(F.lit("  • [Doc #"), "document_id", F.lit("] "), F.coalesce("title", F.lit("Untitled")), F.lit(" ("), F.coalesce("date", F.lit("?")), F.lit(") — "), F.coalesce("role", F.lit("")))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.asc_nulls_last("date"), "document_id", "role"))
    first = appearances.withColumn("at", place).where(F.col("at") <= 30)
    shown = first.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("d"))
    other = F.concat(F.lit("  • "), "name", F.lit(" ("), "type", F.lit(") — "), "shared", F.lit(" document(s)"))
    with_ = companions.where("place <= 10").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", other.alias("line")))).alias("c"))
    both = entity.join(shown, "id", "left").join(with_, "id", "left")
    lines = {x: F.array_join(F.transform(x, lambda e: e["line"]), "\n") for x in ("d", "c")}
    head = F.concat(F.lit("# Entity: "), "name", F.lit(" ("), F.initcap("type"), F.lit(")\n**Documents:** "), F.coalesce(F.size("d"), F.lit(0)), F.lit("\n\n**Document Appearances:**"))
    return both.select("id", F.concat_ws("\n", head, F.nullif(lines["d"], F.lit("")), F.concat(F.lit("\n**Frequently Co-occurs With:**\n"), lines["c"])).alias("text"))
