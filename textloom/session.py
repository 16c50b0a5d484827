"""SparkSession factory with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "textloom", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, skew-join handling and UTC; local when no master is configured."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if not os.environ.get("SPARK_MASTER_SET"):
        b = b.master(f"local[{n}]").config("spark.driver.memory", os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
