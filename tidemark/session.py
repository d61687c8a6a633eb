"""Session defaults the library relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no Python call-site capture for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a folder on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix=f"tidemark-{os.getpid()}-")
    sc.setCheckpointDir(folder)
    return folder


def pinned(df):
    """Reliable checkpoint: the frame is computed once and read back from then on.

    Needed before a floating-point result is joined to itself, because a second
    evaluation may add the same numbers in another order.  Runs a job.
    """
    shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_held: list[str] = []


def held(df):
    """The frame written once below the shared folder and read back from then on.

    For a floating-point result that is joined to itself, as a second evaluation may add
    the same numbers in another order.  Runs a job.  The files are removed when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/held-{uuid4().hex}"
    if not _held:
        atexit.register(release, spark)
    _held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the files of all frames held so far; those frames can't be read any more."""
    jsc = spark.sparkContext._jsc
    if jsc is not None and not jsc.sc().isStopped():
        while _held:
            remove(spark, _held.pop())
