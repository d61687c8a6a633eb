"""Questions about one day, or about the whole rollup.

Each function takes the layers it reads.  ``day`` is a ``datetime.date``; the
year is derived from it so that the partition filter always applies.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify, scores
from tidemark.functions.calendar import month_start
from tidemark.functions.text import no_null_list
from tidemark.settings import Settings


def on_day(layer: DataFrame, column: str, day: date, metric: str | None = None) -> DataFrame:
    """Rows of one day; prunes to its year and, if given, its metric."""
    rows = layer.filter((F.col("year") == day.year) & (F.col(column) == F.lit(day)))
    return rows if metric is None else rows.filter(F.col("metric") == metric)


PLACE = ["entity_id", "station_name", "region", "state", "latitude", "longitude"]


def slice_of_day(daily: DataFrame, stations: DataFrame, metric: str | None, day: date) -> DataFrame:
    """Every placed entity on one day."""
    return (
        on_day(daily, "observed_at", day, metric)
        .join(stations.select(*PLACE), "entity_id")
        .select(
            *PLACE, "metric", "average", "anomaly_score", "flow_percentile", "rise_rate_3d",
            "daily_change", "completeness_score", "record_proximity",
        )
    )


def dataset_stats(daily: DataFrame, metric: str | None = None) -> DataFrame:
    """Rows, newest day and share of gap rows per metric."""
    rows = daily if metric is None else daily.filter(F.col("metric") == metric)
    gap = F.when(F.col("completeness_score") > 0, 0.0).otherwise(1.0)
    return rows.groupBy("metric").agg(
        F.count("*").alias("total_rows"),
        F.max("observed_at").alias("last_date"),
        F.avg(gap).alias("gap_rate"),
    )


def dataset_totals(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows over all metrics, number of stations and newest day."""
    return daily.agg(
        F.count("*").alias("total_rows"), F.max("observed_at").alias("latest_date")
    ).withColumn("n_stations", stations.agg(F.count("*")).scalar())


def lowest_region(placed: DataFrame) -> DataFrame:
    """Region with the lowest mean score; the first by name on a draw."""
    return (
        placed.filter(F.col("region").isNotNull())
        .groupBy("region").agg(F.avg("anomaly_score").alias("mean_z"))
        .filter(F.col("mean_z").isNotNull())
        .agg(F.min_by("region", F.struct("mean_z", "region")).alias("region"))
    )


def fastest_riser() -> Column:
    """Entity with the largest rise; unknown rises last, then by id."""
    rise = F.col("rise_rate_3d")
    riser = F.struct("entity_id", "station_name", rise, F.col("average").alias("value"))
    return F.min_by(riser, F.struct(rise.isNull(), -rise, "entity_id"))


def kpi_cards(
    daily: DataFrame, stations: DataFrame, metric: str, day: date, cfg: Settings = Settings()
) -> DataFrame:
    """One row: events, fastest riser, lowest region and data health."""
    placed = slice_of_day(daily, stations, metric, day)
    health = dataset_stats(daily, metric).select(
        F.struct("gap_rate", "total_rows", "last_date")
    ).scalar()
    filled = F.col("total_gauges") > 0
    return (
        placed.agg(
            F.count_if(scores.is_extreme(F.col("anomaly_score"), cfg.extreme_z))
            .alias("extreme_events_today"),
            fastest_riser().alias("fastest_riser"),
            F.count_if(F.col("completeness_score") > 0).alias("gauges_reporting"),
            F.count("*").alias("total_gauges"),
        )
        .withColumn("most_below_normal", lowest_region(placed).scalar())
        .withColumn("health", F.when(filled, health))
        .select(
            "extreme_events_today", "fastest_riser", "most_below_normal",
            F.when(filled, F.col("gauges_reporting")).alias("gauges_reporting"),
            F.when(filled, F.col("total_gauges")).alias("total_gauges"),
            "health.gap_rate", "health.total_rows", "health.last_date",
        )
    )


def events_by_day_and_metric(category: DataFrame) -> DataFrame:
    return category.groupBy("date", "metric").agg(
        F.sum("event_count").alias("events"), F.sum("extreme_entity_count").alias("extreme")
    )


def top_anomaly_dates(category: DataFrame, n: int = 2) -> DataFrame:
    """The n days with most events, each with a map metric -> events.

    The days are chosen first, so metrics are only gathered for those n.
    """
    top = (
        category.groupBy("date")
        .agg(F.sum("event_count").alias("total_events"),
             F.sum("extreme_entity_count").alias("total_extreme"))
        .orderBy(F.desc("total_events"), "date").limit(n)
    )
    entry = F.struct("metric", "events")
    return (
        events_by_day_and_metric(category).join(top, "date")
        .groupBy("date", "total_events", "total_extreme")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("metrics_breakdown"))
        .orderBy(F.desc("total_events"), "date")
    )


def anomaly_breakdown(
    daily: DataFrame, stations: DataFrame, day: date | None = None, cfg: Settings = Settings()
) -> DataFrame:
    """Extreme entities of a day, strongest first, or of all days in no order."""
    rows = daily if day is None else on_day(daily, "observed_at", day)
    found = (
        rows.filter(scores.is_extreme(F.col("anomaly_score"), cfg.extreme_z))
        .join(stations.select("entity_id", "station_name", "region"), "entity_id")
        .select("observed_at", "entity_id", "station_name", "region", "metric",
                "anomaly_score", "average")
    )
    if day is None:
        return found
    return found.orderBy(F.abs("anomaly_score").desc_nulls_last(), "entity_id", "metric")


def monthly_anomaly_counts(category: DataFrame) -> DataFrame:
    """Events per month over all metrics and regions, months above mean + 1σ flagged."""
    monthly = category.groupBy(month_start(F.col("date")).alias("year_month")).agg(
        F.sum("event_count").alias("total_events"),
        F.sum("extreme_entity_count").alias("total_extreme"),
    )
    threshold = monthly.agg(F.avg("total_events") + F.stddev_samp("total_events")).scalar()
    return (
        monthly.select(
            "year_month", F.year("year_month").alias("year"), F.month("year_month").alias("month"),
            "total_events", "total_extreme", threshold.alias("threshold"),
        )
        .withColumn("is_high", classify.above(F.col("total_events"), F.col("threshold")))
        .orderBy("year_month")
    )


def marker_sizes(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Add ``marker_size``: 5..20 by square root within the keys, 8 when unknown.

    The range is an aggregate, so no group is pulled into one task.  Without keys it
    is a scalar; otherwise it is joined back.
    """
    root = F.when(F.col(value) >= 0, F.sqrt(value))
    ends = F.min(root).alias("_lo"), F.max(root).alias("_hi")
    if keys:
        df = df.join(df.groupBy(*keys).agg(*ends), keys, "left")
    else:
        span = df.agg(F.struct(*ends)).scalar()
        df = df.withColumns({"_lo": span["_lo"], "_hi": span["_hi"]})
    scaled = 5.0 + 15.0 * (root - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    size = F.when((F.col("_hi") > F.col("_lo")) & root.isNotNull(), F.bround(scaled, 1))
    return df.withColumn("marker_size", F.coalesce(size, F.lit(8.0))).drop("_lo", "_hi")


def map_data(
    daily: DataFrame, stations: DataFrame, metric: str | None, day: date
) -> DataFrame:
    """One row per entity and metric with its colour code and marker size."""
    placed = slice_of_day(daily, stations, metric, day).select(
        "entity_id", "station_name", "latitude", "longitude", "metric",
        F.col("average").alias("value"), "anomaly_score", "flow_percentile", "region", "state",
    )
    keys = [] if metric else ["metric"]
    return marker_sizes(placed, "value", keys).withColumn(
        "z_code", classify.z_code(F.col("anomaly_score"))
    )


def region_table(
    category: DataFrame, metric: str | None, day: date, region: str | None = None
) -> DataFrame:
    """Rollup rows of a day, highest mean score first; riser list never null."""
    rows = on_day(category, "date", day, metric)
    if region is not None:
        rows = rows.filter(F.col("region") == region)
    kind = category.schema["fastest_risers"].dataType.elementType
    return rows.select(
        "region", "metric", "entity_count", "event_count", "average_anomaly",
        no_null_list(F.col("fastest_risers"), kind).alias("fastest_risers"),
    ).orderBy(F.col("average_anomaly").desc_nulls_last(), "region", "metric")


def risers(
    category: DataFrame, metric: str | None = None, day: date | None = None,
    region: str | None = None, cfg: Settings = Settings(),
) -> DataFrame:
    """Riser lists as rows with their position; any of the filters may be left out."""
    rows = category if day is None else on_day(category, "date", day)
    for name, wanted in (("metric", metric), ("region", region)):
        if wanted is not None:
            rows = rows.filter(F.col(name) == wanted)
    known = F.filter("fastest_risers", lambda r: r["rise_rate_3d"].isNotNull())
    # fastest first, then by id: sort on the negated rise
    keyed = F.transform(known, lambda r: F.struct((-r["rise_rate_3d"]).alias("k"), r["entity_id"].alias("id"), r.alias("r")))
    best = F.slice(F.array_sort(keyed), 1, cfg.top_risers)
    return (
        rows.select("date", "region", "metric", F.posexplode(best).alias("_pos", "_item"))
        .select(
            "date", "region", "metric", (F.col("_pos") + 1).alias("rank"),
            *[F.col(f"_item.r.{c}").alias(c)
              for c in ("entity_id", "station_name", "rise_rate_3d", "value")],
        )
    )


def newest_day(daily: DataFrame, metric: str) -> date | None:
    """Newest day of a metric.

    Runs two small jobs: the newest year comes from the folder names, its newest day
    from that folder only.
    """
    rows = daily.filter(F.col("metric") == metric)
    year = rows.agg(F.max("year").alias("y")).first()["y"]
    if year is None:
        return None
    return rows.filter(F.col("year") == year).agg(F.max("observed_at").alias("d")).first()["d"]


def coverage_by_day(
    daily: DataFrame, stations: DataFrame, metric: str, days: int, last: date | None = None
) -> DataFrame:
    """Share of placed entities with a value on each of the metric's last days."""
    rows = daily.filter(F.col("metric") == metric)
    last = last or newest_day(daily, metric)
    if last is None:
        rows = rows.filter(F.lit(False))
    else:
        first = last - timedelta(days=days - 1)
        rows = rows.filter(
            F.col("year").between(first.year, last.year)
            & F.col("observed_at").between(F.lit(first), F.lit(last)))
    return (
        rows.join(stations.select("entity_id"), "entity_id")
        .groupBy("observed_at")
        .agg(F.avg(F.col("average").isNotNull().cast("int")).alias("coverage"))
    )


def default_date(
    daily: DataFrame, stations: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """Newest recent day with enough coverage, else the newest day."""
    last = newest_day(daily, cfg.flow_metric)
    recent = coverage_by_day(daily, stations, cfg.flow_metric, cfg.default_lookback, last)
    covered = F.max(F.when(F.col("coverage") >= cfg.default_coverage, F.col("observed_at")))
    return recent.agg(covered.alias("_day")).select(
        F.coalesce("_day", F.lit(last).cast("date")).alias("default_date"))


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group, the smallest one on a draw."""
    counts = df.select(group, value).dropna().groupBy(group, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value)
    )


def region_states(
    category: DataFrame, stations: DataFrame, states: DataFrame, metric: str, day: date
) -> DataFrame:
    """One row per state of ``states`` with its region's score, counts and code."""
    rolled = on_day(category, "date", day, metric).select(
        "region", "average_anomaly", "entity_count", "event_count"
    )
    known = F.col("average_anomaly").isNotNull()
    return (
        states.select("state").distinct()
        .join(most_frequent(stations, "state", "region"), "state", "left")
        .join(rolled, "region", "left")
        .select(
            "state", "region", F.col("average_anomaly").alias("avg_z"),
            F.when(known, F.col("entity_count")).otherwise(0).alias("n"),
            F.when(known, F.col("event_count")).otherwise(0).alias("events"),
            classify.z_code(F.col("average_anomaly"), F.col("region")).alias("code"),
        )
    )


def frequency(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by)
