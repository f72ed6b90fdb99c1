"""Sinks (S7, S10, S12): timeline files, JSON lines and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a timeline file, in order.
TIMELINE_COLUMNS = ("date", "type", "label", "doc_id", "doc_title", "seller", "buyer", "price", "currency", "auction_house", "lot_number", "location", "notes", "score", "entity_names", "medium", "is_key_evidence")
#: Says that a file is UTF-8; stands before the first header of each part.
MARK = "\ufeff"


def timeline_rows(events: DataFrame) -> DataFrame:
    """The columns as text; those that are missing stay empty, others are left out, a list of names is joined."""
    kinds = dict(events.dtypes)

    def text(c: str):
        if c not in kinds:
            return F.lit("")
        value = F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c).cast("string")
        return F.coalesce(value, F.lit(""))

    return events.select(*(text(c).alias(c) for c in TIMELINE_COLUMNS))


def timeline_csv(events: DataFrame, path: str) -> None:
    """A file for each part, each with the mark and the header."""
    rows = timeline_rows(events)
    marked = rows.withColumnRenamed(TIMELINE_COLUMNS[0], MARK + TIMELINE_COLUMNS[0])
    marked.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, template: str, *columns: str) -> DataFrame:
    """A line of text for each row."""
    return df.select(F.format_string(template, *columns).alias("line"))
