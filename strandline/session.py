"""SparkSession factory with the settings every operator assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results or plans; cluster sizing stays with the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` keys use `__` for dots and win over DEFAULTS."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
