"""Lineage cuts and working folders that all executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two requests to collect garbage, and the time of the last one.
RELEASE, released = 4.0, 0.0


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, read from the session.

    It must be one that all executors share. Where none is set, a local master
    (tests, a notebook) gets a folder of its own; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[0-9*]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A folder of its own in the shared one; whoever asks for it also removes it."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder.

    Spark removes files of shuffles, and of checkpoints if
    spark.cleaner.referenceTracking.cleanCheckpoints is on, once the driver's JVM has
    collected what they belong to. A driver that makes little garbage rarely does, so
    it is asked to, at most every RELEASE seconds.
    """
    global released
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    if time.monotonic() - released > RELEASE:
        spark.sparkContext._jvm.System.gc()
        released = time.monotonic()
    return out
