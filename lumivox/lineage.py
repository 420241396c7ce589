"""Cutting lineage between rounds of iterative jobs, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or else the one that was given to the context.

    Where there is neither and Spark runs on this machine alone (as in tests), a new
    local folder serves; on a cluster that is an error.
    """
    path, given = spark.conf.get("spark.checkpoint.dir", None), spark._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return path or given.get()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute the rows once and keep them in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
