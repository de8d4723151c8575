"""Cutting lineage: rows written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where none is set and executors share the driver's disk (master ``local``:
    tests, a laptop) a temporary folder. Elsewhere a missing setting is an error."""
    context = spark.sparkContext
    if (folder := context.getCheckpointDir()) is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="talewind-"))
        folder = context.getCheckpointDir()
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
