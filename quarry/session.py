"""Spark sessions with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE with skew joins and coalescing, Arrow, UTC. On a cluster leave master alone; partitions default to the cores of a local run."""
    b = SparkSession.builder.appName("quarry")
    if master:
        b = b.master(master)
    given = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        given["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.cpu_count() or 8)
        given["spark.driver.memory"] = "8g"
    elif shuffle_partitions:
        given["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (given | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
