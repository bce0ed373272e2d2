"""Session settings the library is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "foreopen", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC time and Arrow; further settings as keyword arguments (``__`` for a dot)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
