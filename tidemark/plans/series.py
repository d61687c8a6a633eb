"""Questions about the series of one entity, or of all of them.

Every ``entity_id``/``metric`` argument may be None, meaning all.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify, scores
from tidemark.functions.calendar import plus_years
from tidemark.functions.text import name_or_id
from tidemark.operators.ranking import competition_rank
from tidemark.plans.dashboard import on_day, slice_of_day
from tidemark.settings import Settings

PLOTTED = ["anomaly_score", "daily_change", "rise_rate_3d", "flow_percentile",
           "completeness_score"]


def pick(df: DataFrame, entity_id: str | None = None, metric: str | None = None) -> DataFrame:
    if entity_id is not None:
        df = df.filter(F.col("entity_id") == entity_id)
    if metric is not None:
        df = df.filter(F.col("metric") == metric)
    return df


def within(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows of an inclusive date span, with the year filter that prunes partitions."""
    return df.filter(
        F.col("year").between(start.year, end.year)
        & F.col("observed_at").between(F.lit(start), F.lit(end))
    )


def hydrograph(
    daily: DataFrame, stations: DataFrame, metric: str, start: date, end: date,
    entity_id: str | None = None, cfg: Settings = Settings(),
) -> DataFrame:
    """Every day of the span per entity, with the overlay metric beside the main one.

    Empty calendar rows are unioned to the data and both metrics are folded in by
    one aggregation, instead of a self-join and a join onto a grid.
    """
    main = F.col("metric") == metric
    data = within(pick(daily, entity_id), start, end).filter(
        F.col("metric").isin(metric, cfg.overlay_metric)
    )
    rows = data.select(
        "entity_id", "observed_at",
        F.when(main, 1).alias("_has"),
        F.when(main, F.col("average")).alias("average"),
        F.when(F.col("metric") == cfg.overlay_metric, F.col("average")).alias("overlay"),
        *[F.when(main, F.col(c)).alias(c) for c in PLOTTED],
    )
    days = F.explode(F.sequence(F.lit(start), F.lit(end)))
    # entities without a station row have a calendar too, and so has one asked for by name
    known = pick(stations, entity_id).select("entity_id").union(rows.select("entity_id"))
    if entity_id is not None:
        known = known.union(stations.sparkSession.range(1).select(F.lit(entity_id)))
    grid = known.distinct().select("entity_id", days.alias("observed_at"))
    values = ["_has", "average", "overlay", *PLOTTED]
    folded = (
        rows.unionByName(grid, allowMissingColumns=True)
        .groupBy("entity_id", "observed_at")
        .agg(*[F.max(c).alias(c) for c in values])
    )
    return folded.select(
        "entity_id", "observed_at", "average",
        F.when(F.col("_has") == 1, F.col("overlay")).alias("water_temp"),
        *PLOTTED[:-1],
        F.coalesce("completeness_score", F.lit(0.0)).alias("completeness_score"),
    )


def baseline_band(
    baselines: DataFrame, start: date, end: date,
    entity_id: str | None = None, metric: str | None = None,
) -> DataFrame:
    """Baselines of the days-of-year in the span; all of them if it wraps."""
    rows = pick(baselines, entity_id, metric)
    first, last = start.timetuple().tm_yday, end.timetuple().tm_yday
    if first <= last:
        rows = rows.filter(F.col("day_of_year").between(first, last))
    return rows.select("entity_id", "metric", "day_of_year", "mu", "sigma")


def banded_hydrograph(
    daily: DataFrame, baselines: DataFrame, stations: DataFrame, metric: str,
    start: date, end: date, entity_id: str | None = None, cfg: Settings = Settings(),
) -> DataFrame:
    """Hydrograph with ±1σ and ±2σ bands of each date's day-of-year, events and gaps."""
    series = hydrograph(daily, stations, metric, start, end, entity_id, cfg)
    band = pick(baselines, entity_id, metric).select("entity_id", "day_of_year", "mu", "sigma")
    mu, sigma = F.col("mu"), F.col("sigma")
    lo1, hi1 = scores.band(mu, sigma, 1.0)
    lo2, hi2 = scores.band(mu, sigma, 2.0)
    event = scores.is_extreme(F.col("anomaly_score"), cfg.extreme_z) & F.col("average").isNotNull()
    return (
        series.withColumn("day_of_year", F.dayofyear("observed_at"))
        .join(band, ["entity_id", "day_of_year"], "left")
        .withColumns({
            "lower_1s": lo1, "upper_1s": hi1, "lower_2s": lo2, "upper_2s": hi2,
            "is_event": F.coalesce(event, F.lit(False)),
            "is_gap": F.col("completeness_score") == 0,
            "z_code": classify.z_code(F.col("anomaly_score")),
        })
    )


def value_range(banded: DataFrame) -> DataFrame:
    """Lowest and highest plotted value per entity, bands included."""
    low = F.least("mu", "lower_2s", "average")
    high = F.greatest("mu", "upper_2s", "average")
    return banded.groupBy("entity_id").agg(F.min(low).alias("y_min"), F.max(high).alias("y_max"))


def raw_payload(
    raw: DataFrame, metric: str | None, day: date, entity_id: str | None = None
) -> DataFrame:
    """Payload text of the observations of one day, of one metric or of all."""
    return pick(on_day(raw, "observed_at", day), entity_id, metric).select(
        "entity_id", "metric", "observed_at", "raw_payload"
    )


def flashiness(
    daily: DataFrame, stations: DataFrame, metric: str | None = None, year: int | None = None,
    entity_id: str | None = None,
) -> DataFrame:
    """Σ|daily change| / Σ average per entity, metric and year over observed days."""
    rows = pick(daily, entity_id, metric)
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    return (
        rows.filter(
            (F.col("completeness_score") > 0) & F.col("daily_change").isNotNull()
            & (F.col("average") > 0)
        )
        .groupBy("entity_id", "metric", "year")
        .agg(
            F.try_divide(F.sum(F.abs("daily_change")), F.sum("average")).alias("flashiness_index"),
            F.count("*").alias("n_days"),
        )
        .join(stations.select("entity_id", "region"), "entity_id")
    )


def ranked_flashiness(
    daily: DataFrame, stations: DataFrame, metric: str | None = None, year: int | None = None
) -> DataFrame:
    """Flashiness of every entity with its rank in the region, 1 = flashiest.

    Runs a job: the index is checkpointed before it is ranked.
    """
    return competition_rank(
        flashiness(daily, stations, metric, year), ["region", "metric", "year"],
        "flashiness_index", "region_rank", "n_gauges",
    ).withColumn("flashiness_class", classify.flashiness_class(F.col("flashiness_index")))


def flashiness_of(
    daily: DataFrame, stations: DataFrame, entity_id: str, metric: str, year: int
) -> DataFrame:
    """One row for one entity: index, rank in its region, region size and class.

    The rank counts larger values against a scalar, so the region is only ever
    aggregated.  Without an own index the rank is null.
    """
    region = stations.filter(F.col("entity_id") == entity_id).agg(F.max("region")).scalar()
    own = flashiness(daily, stations, metric, year, entity_id).agg(
        F.max(F.struct("flashiness_index", "n_days"))
    ).scalar()
    peers = flashiness(
        daily, stations.filter(F.col("region") == region), metric, year
    ).filter(F.col("entity_id") != entity_id)
    return (
        peers.agg(
            F.count_if(F.col("flashiness_index") > own["flashiness_index"]).alias("_larger"),
            F.count("*").alias("_others"),
        )
        .select(
            F.lit(entity_id).alias("entity_id"), F.lit(year).alias("year"),
            own["flashiness_index"].alias("flashiness_index"),
            F.coalesce(own["n_days"], F.lit(0)).alias("n_days"),
            region.alias("region"), "_larger", "_others",
        )
        .select(
            "entity_id", "year", "region", "flashiness_index", "n_days",
            F.when(F.col("flashiness_index").isNotNull(), F.col("_larger") + 1)
            .alias("region_rank"),
            (F.col("_others") + F.when(F.col("n_days") > 0, 1).otherwise(0)).alias("n_gauges"),
            classify.flashiness_class(F.col("flashiness_index")).alias("flashiness_class"),
        )
    )


def all_time_max(
    daily: DataFrame, metric: str | None = None, entity_id: str | None = None
) -> DataFrame:
    return pick(daily, entity_id, metric).groupBy("entity_id", "metric").agg(
        F.max("average").alias("historical_max")
    )


def personality_cards(
    daily: DataFrame, stations: DataFrame, entity_id: str, metric: str, day: date
) -> DataFrame:
    """One row for one entity: flashiness, percentile, proximity and all-time maximum."""
    today = pick(slice_of_day(daily, stations, metric, day), entity_id).agg(
        F.max(F.struct("average", "flow_percentile", "record_proximity"))
    ).scalar()
    peak = all_time_max(daily, metric, entity_id).agg(F.max("historical_max")).scalar()
    return (
        flashiness_of(daily, stations, entity_id, metric, day.year)
        .withColumnRenamed("region_rank", "flashiness_rank")
        .withColumns({
            "average": today["average"], "flow_percentile": today["flow_percentile"],
            "record_proximity": today["record_proximity"], "historical_max": peak,
        })
        .withColumn("proximity_class", classify.proximity_class(F.col("record_proximity") * 100))
        .drop("year")
    )


def all_personality_cards(
    daily: DataFrame, stations: DataFrame, metric: str, day: date
) -> DataFrame:
    """The same cards for every entity that has a row on the day.  Runs a job."""
    today = pick(on_day(daily, "observed_at", day), None, metric).select(
        "entity_id", "average", "flow_percentile", "record_proximity"
    )
    rank = ranked_flashiness(daily, stations, metric, day.year).select(
        "entity_id", "flashiness_index", F.col("region_rank").alias("flashiness_rank"),
        "n_gauges", "n_days", "flashiness_class",
    )
    peak = all_time_max(daily, metric).select("entity_id", "historical_max")
    return (
        stations.select("entity_id", "region")
        .join(today, "entity_id").join(rank, "entity_id", "left").join(peak, "entity_id", "left")
        .withColumn("proximity_class", classify.proximity_class(F.col("record_proximity") * 100))
    )


def previous_year(
    daily: DataFrame, metric: str | None, year: int, entity_id: str | None = None
) -> DataFrame:
    """Averages of the year before, moved onto the dates of ``year``; ordered for one entity."""
    rows = pick(daily, entity_id, metric).filter(F.col("year") == year - 1)
    moved = rows.filter(F.col("average").isNotNull()).select(
        "entity_id", "metric", plus_years(F.col("observed_at"), 1).alias("observed_at"), "average"
    )
    return moved if entity_id is None else moved.orderBy("metric", "observed_at")


def window_stats(
    daily: DataFrame, metric: str, start: date, end: date, entity_id: str | None = None
) -> DataFrame:
    """Last known value, score, percentile and proximity per entity in a span.

    Score and percentile are each the last known one, which may be of another day
    than the last value.
    """
    rows = within(pick(daily, entity_id, metric), start, end)

    def last_known(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("observed_at")))

    valued = F.when(F.col("average").isNotNull(), F.col("observed_at"))
    return (
        rows.groupBy("entity_id").agg(
            F.max(valued).alias("last_date"),
            last_known("average").alias("average"),
            last_known("anomaly_score").alias("anomaly_score"),
            last_known("flow_percentile").alias("flow_percentile"),
            F.max_by("record_proximity", valued).alias("record_proximity"),
        )
        .filter(F.col("last_date").isNotNull())
        .withColumn("proximity_class", classify.proximity_class(F.col("record_proximity") * 100))
    )


def entity_names(ids: DataFrame, stations: DataFrame) -> DataFrame:
    """Station name per id, the id itself when there is none."""
    return ids.select("entity_id").distinct().join(
        stations.select("entity_id", "station_name"), "entity_id", "left"
    ).select("entity_id", name_or_id(F.col("station_name"), F.col("entity_id")).alias("label"))
