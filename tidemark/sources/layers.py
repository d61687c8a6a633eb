"""Readers of the stored layers and of the CSV dimensions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, types as T
from pyspark.sql import functions as F

from tidemark.sources.versions import Versioned


def with_partitions(schema: T.StructType, names: list[str]) -> T.StructType:
    known = set(schema.fieldNames())
    kinds = {"year": T.IntegerType()}
    extra = [T.StructField(n, kinds.get(n, T.StringType())) for n in names if n not in known]
    return T.StructType(schema.fields + extra)


def read_layer(
    spark: SparkSession, path: str, schema: T.StructType,
    partitions: tuple[str, ...] = ("metric", "year"),
) -> DataFrame:
    """The current version of a layer stored as metric=/year=/; filters on those columns prune folders."""
    return Versioned(spark, path, partitions).read(with_partitions(schema, list(partitions)))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return Versioned(spark, path).read(schema)


def read_years(layer: DataFrame, since: date, end: date) -> DataFrame:
    """Only the year partitions a fetch of [since, end] can touch."""
    return layer.filter(F.col("year").between(since.year, end.year))


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; codes with leading zeros stay text."""
    def load(reader: DataFrameReader, paths: list[str]) -> DataFrame:
        options = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE"}
        return reader.options(**options).csv(paths)

    return Versioned(spark, path).read(schema, load)


def register(**views: DataFrame) -> None:
    """Make frames available to ``spark.sql`` under the given names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
