"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, gone when the driver exits; a local one only in local mode without it."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + os.path.join(tempfile.gettempdir(), "quern-scratch")
    path = f"{there}/quern/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass
