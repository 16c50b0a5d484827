"""The folder that all executors share, and lineage cuts through it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its scan has fewer: a small file with one row group can't be split by the
    scan. A table of many splits is left alone and isn't shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine (tests), a folder of its own that goes at exit.

    On a cluster that names no folder this raises: each executor would write to its own disk, and its rows would be lost to the others."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        base = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"textloom-{uuid.uuid4().hex}", name)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what comes after it never recomputes what came before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
