"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, one is made on a local master only: executors share nothing else."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Made once and written: what is used several times isn't made again, and lost executors cost no more than their tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
