"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "docweave", **settings: str) -> SparkSession:
    """A session with UTC and adaptive execution; ``settings`` add to or replace these. Cluster sizes are left to the cluster."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | settings).getOrCreate()
