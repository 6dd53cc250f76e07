"""Cutting a long lineage: rows are written to the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new one on this machine only where none is set and all runs on this
    machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by its columns to as many tasks as a shuffle has. Few bytes that cost much to compute on would otherwise
    be put together into one task after a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def settle(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
