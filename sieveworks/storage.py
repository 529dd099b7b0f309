"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset and Spark runs on this machine alone (as in tests) a new
    folder, which then becomes the checkpoint folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.getCheckpointDir() and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sieveworks-"))
    return configured or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, in its partitions, with the lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
