"""SparkSession factory used by tests, the benchmark and local runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow transfer. On a cluster pass conf through spark-submit instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tempora")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TEMPORA_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
