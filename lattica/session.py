"""The session that the engine is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "lattica", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, Arrow, UTC; everything else (cores, memory, partitions) is the cluster's to say."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
