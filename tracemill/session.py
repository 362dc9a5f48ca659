"""Spark settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a repeated key of a lookup keeps its last value, as a dictionary does
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(name: str = "tracemill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``settings`` override them (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
