"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: White space of the query contracts, as the inside of a regular-expression class.
SPACE = r"\x20\x09-\x0D"
_staged: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_remove_staged, spark)
    _staged.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts the lineage, so that work is neither repeated nor lost with an executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_staged(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    for path in _staged:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
