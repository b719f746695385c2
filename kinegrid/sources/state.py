"""Settled intermediate tables: written to the folder that driver and executors share, so a lost executor loses none of them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder stands in only where none is set and all of Spark is this process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kinegrid-")
        context.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = folder(df.sparkSession)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(found)
    return df.checkpoint()
