"""A SparkSession with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "freshet", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting, and small Arrow batches for wide text rows; ``conf`` overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
