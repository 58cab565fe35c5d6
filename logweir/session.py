"""A session with the settings that the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "logweir", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings come from spark-submit or ``settings``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
