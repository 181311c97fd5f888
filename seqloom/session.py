"""Sessions with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "seqloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution.  Sizes of shuffles and
    splits stay with the cluster's own settings."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}})
    return (builder.master(master) if master else builder).getOrCreate()
