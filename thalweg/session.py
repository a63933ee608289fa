"""A session with the settings the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "thalweg", **conf: str) -> SparkSession:
    """UTC session time zone, adaptive execution with skew handling, Arrow for Python exchange."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
