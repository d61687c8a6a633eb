"""Daily statistics and the gap-filled daily layer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scores
from tidemark.functions.calendar import DOY_CYCLE

SERIES = ["entity_id", "metric"]


def observed(raw: DataFrame) -> DataFrame:
    """Observations that carry a value and a date; the others are gaps, or belong to no day."""
    return raw.select(*SERIES, "observed_at", "value").filter(
        F.col("value").isNotNull() & F.col("observed_at").isNotNull())


def daily_stats(raw: DataFrame) -> DataFrame:
    """One row per series and observed day.

    Plain aggregates, so Spark combines them before the shuffle: however many
    readings one entity has, at most one row per day and task leaves a task.
    Afterwards a series holds no more rows than its calendar has days, which is
    what bounds every per-series window below.
    """
    return observed(raw).groupBy(*SERIES, "observed_at").agg(
        F.count("*").cast("int").alias("observation_count"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        (F.sum("value") / F.count("*")).alias("average"),
    )


def with_percentile(daily: DataFrame) -> DataFrame:
    """Share of the series' observed days at or below the day's average, in percent."""
    w = Window.partitionBy(*SERIES).orderBy("average")
    return daily.withColumn("flow_percentile", F.cume_dist().over(w) * 100.0)


def with_changes(daily: DataFrame) -> DataFrame:
    """Change features of observed days, looked up by calendar distance.

    Among the k rows before a day, the one exactly k days back is the only one that
    counts; without it the difference would span a gap and is null.
    """
    by_day = Window.partitionBy(*SERIES).orderBy("observed_at")
    value = F.col("average")

    def days_back(k: int) -> Column:
        rows = [
            F.when(F.datediff("observed_at", F.lag("observed_at", i).over(by_day)) == k,
                   F.lag("average", i).over(by_day))
            for i in range(1, k + 1)
        ]
        return F.coalesce(*rows)

    return (
        daily.withColumns({
            "daily_change": value - days_back(1),
            "rise_rate_3d": (value - days_back(3)) / 3.0,
            "_peak": F.max(value).over(Window.partitionBy(*SERIES)),
            "_next": F.lead("observed_at").over(by_day),
        })
        .withColumn("record_proximity", F.try_divide(value, F.col("_peak")))
        .drop("_peak")
    )


def fill_calendar(daily: DataFrame, today: Column, values: list[str]) -> DataFrame:
    """Repeat each row over the unobserved days that follow it, values nulled.

    ``_next`` is the series' next observed day.  Extending rows forward gives the
    dense calendar without building a grid and joining it.  Day numbers are used for
    the sequence, as stepping through dates is much slower.
    """
    first = F.unix_date("observed_at")
    last = F.coalesce(F.unix_date("_next") - 1, F.unix_date(today))
    kept = [c for c in daily.columns if c not in {*values, "observed_at", "_next"}]
    return (
        daily.withColumn("_day", F.explode(F.sequence(first, last)))
        .select(
            *kept,
            F.date_from_unix_date("_day").alias("observed_at"),
            *[F.when(F.col("_day") == first, F.col(v)).alias(v) for v in values],
        )
    )


def seasonal_profile(baselines: DataFrame) -> DataFrame:
    """One row per series: arrays of mu and sigma, indexed by day-of-year − 1."""
    days = F.array_sort(F.collect_list(F.struct("day_of_year", "mu", "sigma")))
    complete = F.size("_days") == DOY_CYCLE
    broken = F.raise_error(F.concat_ws(
        " ", F.lit("baselines lack days-of-year for"), *SERIES)).cast("array<double>")
    return baselines.groupBy(*SERIES).agg(days.alias("_days")).select(
        *SERIES,
        F.when(complete, F.col("_days.mu")).otherwise(broken).alias("_mu"),
        F.when(complete, F.col("_days.sigma")).otherwise(broken).alias("_sigma"),
    )


def newest_observed(raw: DataFrame) -> date | None:
    """Newest day with a value, from a narrow pass without a shuffle of rows.  Runs a job."""
    return observed(raw).agg(F.max("observed_at").alias("d")).first()["d"]


def last_day(daily: DataFrame) -> Column:
    """Newest observed day, as a scalar subquery."""
    return daily.agg(F.max("observed_at")).scalar()


def daily_entity_metrics(
    daily: DataFrame, baselines: DataFrame, today: date | Column | None = None
) -> DataFrame:
    """The dense daily layer, first observed day of a series .. ``today``.

    ``daily`` comes from :func:`daily_stats`.  Without ``today`` it is planned twice, once for
    its newest day; :func:`newest_observed` gives that more cheaply.  All windows share the partitioning
    by series, and so does the join with the baselines: it is keyed by the series
    alone, the day-of-year being looked up in the joined profile.
    """
    ranked = with_percentile(daily)
    if today is None:
        end = last_day(daily)
    else:
        end = today if isinstance(today, Column) else F.lit(today)
        ranked = ranked.filter(F.col("observed_at") <= end)
    changed = with_changes(ranked)
    doy = F.dayofyear("observed_at") - 1
    scored = changed.join(seasonal_profile(baselines), SERIES, "left").withColumn(
        "anomaly_score",
        scores.z_score(F.col("average"), F.get("_mu", doy), F.get("_sigma", doy)),
    ).drop("_mu", "_sigma")
    values = [
        "observation_count", "minimum", "maximum", "average", "daily_change",
        "rise_rate_3d", "flow_percentile", "anomaly_score", "record_proximity",
    ]
    dense = (
        fill_calendar(scored, end, values)
        .withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
        .withColumn("completeness_score", scores.completeness(F.col("observation_count")))
        .withColumn("year", F.year("observed_at"))
    )
    return schemas.conform(dense, schemas.DAILY_ENTITY_METRICS)
