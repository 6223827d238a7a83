"""Frames that are written once and read by many: their plan ends at files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set or named in spark.checkpoint.dir; only a local session without one gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def staged(frame: DataFrame) -> DataFrame:
    """The frame from files, so that plans that use it several times run what is before it once."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
