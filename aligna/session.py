"""Session factory with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "aligna", **conf: str) -> SparkSession:
    """UTC and adaptive execution; everything else is left to the cluster or to conf."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
