"""Session construction with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "loomstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling on; ``conf`` adds settings (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
