"""Ranks within groups that may be far too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import held


def competition_rank(
    df: DataFrame, group: list[str], value: str, out: str, size: str, buckets: int = 64
) -> DataFrame:
    """Add ``out``, 1 + the number of larger values in the group, and its ``size``.

    Both are null for a null value, which is not counted either.
    Exact for any distribution.  Values are first counted, so one shared by most
    rows becomes a single row, then split into ordered buckets at approximate
    percentiles of their group.  A rank is the count in higher buckets plus the
    count of larger values in the same bucket; no task sees a whole group.
    The input is written once and reread, as it is joined to its own values.  Group keys are
    compared as structs, in which nulls are equal.
    """
    df = held(df).withColumns({"_group": F.struct(*group), "_value": F.col(value)})
    counts = (
        df.filter(F.col("_value").isNotNull())
        .groupBy("_group", "_value").agg(F.count("*").alias("_n"))
    )
    steps = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy("_group").agg(F.percentile_approx("_value", steps).alias("_cuts"))
    split = counts.join(cuts, "_group").select(
        "_group", "_value", "_n",
        F.size(F.filter("_cuts", lambda c: c < F.col("_value"))).alias("_bucket"),
    )
    preceding = (Window.unboundedPreceding, -1)
    by_bucket = Window.partitionBy("_group").orderBy(F.desc("_bucket")).rowsBetween(*preceding)
    inside = (
        Window.partitionBy("_group", "_bucket").orderBy(F.desc("_value")).rowsBetween(*preceding)
    )
    above = (
        split.groupBy("_group", "_bucket").agg(F.sum("_n").alias("_total"))
        .select(
            "_group", "_bucket",
            F.sum("_total").over(by_bucket).alias("_above"),
            F.sum("_total").over(Window.partitionBy("_group")).alias(size),
        )
    )
    ranks = (
        split.withColumn("_larger", F.sum("_n").over(inside))
        .join(above, ["_group", "_bucket"])
        .select(
            "_group", "_value",
            (F.coalesce("_above", F.lit(0)) + F.coalesce("_larger", F.lit(0)) + 1).alias(out),
            size,
        )
    )
    return df.join(ranks, ["_group", "_value"], "left").drop("_group", "_value")
