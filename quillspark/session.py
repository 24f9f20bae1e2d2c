"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, Arrow exchange and UTC; an existing one is returned as it is."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
