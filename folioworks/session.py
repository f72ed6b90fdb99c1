"""A session with the settings that the archive engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "folioworks", **settings: str) -> SparkSession:
    """UTC, adaptive plans; everything else is the cluster's or the caller's."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=conf | settings).getOrCreate()
