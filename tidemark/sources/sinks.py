"""Writers.  Every function here runs a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.versions import Save, Versioned

LAYOUT = ["metric", "year"]

#: Parts of a partition folder that may become a task and a file each, so that few folders do not mean few tasks.
PARTS = 4


def laid_out(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows gathered by partition folder, and by part of its first sort column, and sorted for row-group skipping.

    The rebalance hint lets adaptive execution split a part that is too large for
    one task and merge the small ones, which a plain repartition by metric and year
    could not: there are only as many of those as metrics times years.
    """
    part = F.pmod(F.xxhash64(order[0]), F.lit(PARTS))
    return df.withColumn("_part", part).hint("rebalance", *LAYOUT, "_part").drop("_part").sortWithinPartitions(*LAYOUT, *order)


def save_layer(order: list[str]) -> Save:
    """Writer of metric=/year=/ folders, with a Bloom filter of the entities where rows have one."""
    def save(df: DataFrame, target: str) -> None:
        writer = laid_out(df, order).write.mode("overwrite").option("partitionOverwriteMode", "static")
        if "entity_id" in order:
            # a file of a batch spans many entities: its bounds alone would let hardly one be skipped
            writer = writer.option("parquet.bloom.filter.enabled#entity_id", "true").option(
                "parquet.bloom.filter.adaptive.enabled", "true")
        writer.partitionBy(*LAYOUT).parquet(target)

    return save


def _replace(df: DataFrame, path: str, save: Save, partitions: list[str], only_touched: bool = False) -> None:
    target = Versioned(df.sparkSession, path, partitions)
    target.replace(target.write(df, save), only_touched)


def write_layer(df: DataFrame, path: str, order: list[str], only_touched: bool = False) -> None:
    """Write metric=/year=/ folders; replace all of them or only those in ``df``.

    Readers see the old rows until all new ones are written (see :mod:`tidemark.sources.versions`).
    """
    _replace(df, path, save_layer(order), LAYOUT, only_touched)


RAW_ORDER = DAILY_ORDER = ["entity_id", "observed_at"]


def write_daily(df: DataFrame, path: str) -> None:
    write_layer(df, path, DAILY_ORDER)


def write_category(df: DataFrame, path: str) -> None:
    write_layer(df, path, ["date", "region"])


def write_raw(df: DataFrame, path: str, only_touched: bool = False) -> None:
    rows = df if "year" in df.columns else df.withColumn("year", F.year("observed_at"))
    write_layer(rows, path, RAW_ORDER, only_touched)


def partition_counts(layer: DataFrame) -> DataFrame:
    """Rows per partition folder."""
    return layer.groupBy(*LAYOUT).agg(F.count("*").alias("n_rows"))


def save_table(order: list[str] | None = None) -> Save:
    """Writer of an unpartitioned table, clustered by its sort columns."""
    def save(df: DataFrame, target: str) -> None:
        if order:
            df = df.hint("rebalance", order[0]).sortWithinPartitions(*order)
        df.write.mode("overwrite").parquet(target)

    return save


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Replace an unpartitioned table; readers see the old rows until then."""
    _replace(df, path, save_table(order), [])


def flat_lists(df: DataFrame) -> DataFrame:
    """Array columns as text joined by ';', since CSV has no arrays."""
    return df.select(*[
        F.concat_ws(";", c).alias(c) if kind.startswith("array<string") else F.col(c)
        for c, kind in df.dtypes
    ])


def _save_csv(df: DataFrame, target: str) -> None:
    flat_lists(df).write.mode("overwrite").option("header", True).csv(target)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV table; readers see the old rows until then."""
    _replace(df, path, _save_csv, [])


def export_history(raw: DataFrame, entity_id: str, metric: str) -> DataFrame:
    """Whole raw history of one series in date order, ready for :func:`write_csv`."""
    rows = raw.filter((F.col("entity_id") == entity_id) & (F.col("metric") == metric))
    return flat_lists(rows).orderBy("observed_at")
