"""A session with the settings the engine is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Column names are case-sensitive, times are UTC, and Spark re-plans joins and partitions from what it measures.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "weft", master: str | None = None, **settings: str) -> SparkSession:
    """A session; settings override SETTINGS and use __ for the dots of their names."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
