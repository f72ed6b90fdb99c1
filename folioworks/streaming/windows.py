"""Late data and joins of streams (K8): sliding and session windows, duplicates within the watermark, interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding(events: DataFrame, keys: list[str], size: str, every: str, late: str = "10 minutes") -> DataFrame:
    """Events (at, ...) by overlapping windows: window, keys, events."""
    return events.withWatermark("at", late).groupBy(F.window("at", size, every), *keys).agg(F.count("*").alias("events"))


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events that no gap divides: window, keys, events; one comes out when the watermark has passed its end."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), *keys).agg(F.count("*").alias("events"))


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without those that repeat their keys within the watermark; state is kept no longer."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of an event of one stream and one of the other, of one key, at most `within` later.

    Both sides have watermarks and the interval bounds both, so Spark drops what nothing can meet any more.
    first: key, at, event_id; then: the same. Returns key, first_id, then_id.
    """
    left = first.withWatermark("at", late).select(F.col(key), F.col("at").alias("first_at"), F.col("event_id").alias("first_id"))
    right = then.withWatermark("at", late).select(F.col(key).alias("then_key"), F.col("at").alias("then_at"), F.col("event_id").alias("then_id"))
    met = (F.col(key) == F.col("then_key")) & F.expr(f"then_at >= first_at AND then_at <= first_at + INTERVAL {within}")
    return left.join(right, met).select(key, "first_id", "then_id")
