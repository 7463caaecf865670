"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "glossalake", **settings: str) -> SparkSession:
    """Session in UTC with adaptive plans; other settings as given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
