"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder: the one that the session names; only a local session may have one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(frame: DataFrame) -> DataFrame:
    """`frame`, written to the shared folder and read from there.  Lost executors lose none of it."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
