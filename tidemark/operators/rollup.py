"""Regional rollup with the fastest risers per region, metric and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scores
from tidemark.settings import Settings

GROUP = ["observed_at", "region", "metric"]


def _with_region(daily: DataFrame, stations: DataFrame) -> DataFrame:
    return daily.join(stations.select("entity_id", "region", "station_name"), "entity_id", "left")


def region_counts(placed: DataFrame, cfg: Settings) -> DataFrame:
    """Rows, events and mean score; every row of the day counts as an entity."""
    events = F.count_if(scores.is_extreme(F.col("anomaly_score"), cfg.extreme_z)).cast("int")
    return placed.groupBy(*GROUP).agg(
        F.count("*").cast("int").alias("entity_count"),
        events.alias("event_count"),
        F.avg("anomaly_score").alias("average_anomaly"),
        events.alias("extreme_entity_count"),
    )


def top_risers(placed: DataFrame, cfg: Settings) -> DataFrame:
    """Ordered list of the k fastest risers of each group.

    The rank filter lets Spark keep only k rows per group in every task before
    the shuffle, so a region that holds most entities is no bottleneck.
    """
    w = Window.partitionBy(*GROUP).orderBy(F.col("rise_rate_3d").desc(), "entity_id")
    kept = (
        placed.filter((F.col("completeness_score") > 0) & F.col("rise_rate_3d").isNotNull())
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= cfg.top_risers)
    )
    riser = F.struct("entity_id", "station_name", "rise_rate_3d", F.col("average").alias("value"))
    listed = F.sort_array(F.collect_list(F.struct("_rank", riser.alias("riser"))))
    return kept.groupBy(*GROUP).agg(
        F.transform(listed, lambda x: x["riser"]).alias("fastest_risers")
    )


def category_metrics(
    daily: DataFrame, stations: DataFrame, cfg: Settings = Settings(), today: date | None = None
) -> DataFrame:
    """One row per day, region and metric.

    Entities without a station row form the region null; it gets counts but, as
    null keys never join, no riser list.
    """
    if today is not None:
        daily = daily.filter(F.col("observed_at") <= F.lit(today))
    placed = _with_region(daily, stations)
    out = (
        region_counts(placed, cfg)
        .join(top_risers(placed, cfg), GROUP, "left")
        .withColumnRenamed("observed_at", "date")
        .withColumn("year", F.year("date"))
    )
    return schemas.conform(out, schemas.DAILY_CATEGORY_METRICS)
