"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder (`spark.checkpoint.dir`).

    Where none is named, and the session runs on one machine, it is a folder in its warehouse. On a cluster a folder that all
    executors reach has to be named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written copy."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a table that only this run needs."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
