"""Where intermediate results live."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """Shared folder named by the session.

    Where none is set, a local session uses a temporary folder; on a cluster
    that is an error, since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tidegrid")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Like a checkpoint it is done once and survives a lost executor; besides, the
    planner knows its size and reads only the columns it needs.
    """
    path = f"{working_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives a lost executor)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(working_folder(df.sparkSession))
    return df.checkpoint()
