"""Intermediate results that outlive a lost executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not there and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="geoloom-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
