"""The session that every plan assumes: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "marlspar", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session; on a cluster leave master to spark-submit and shuffle_partitions to the deployment (a few
    for each core, so that one partition of the largest shuffle fits a task's share of memory)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
