"""Spark sessions for the command line, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int = 0, shuffle_partitions: int = 0, **conf: str) -> SparkSession:
    """A local session, or the one that a submitted job already has. ``cores`` 0: all."""
    n = cores or os.cpu_count() or 1
    builder = SparkSession.builder.appName("cdrforge").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if not os.environ.get("SPARK_ENV_LOADED"):
        builder = builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions or n)).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
