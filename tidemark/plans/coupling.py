"""Questions about the coupling tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify, scores
from tidemark.functions.calendar import period_month, period_start, shift_period
from tidemark.operators.coupling import (
    calendar_month_anomaly, for_each_entity, rank_correlation, true_spans, whole_series_z,
)
from tidemark.operators.upsert import only_in
from tidemark.settings import Settings


def _strongest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.abs("spearman_anom").desc_nulls_last(), "entity_id")


def gauges_with_geo(final: DataFrame, geo: DataFrame) -> DataFrame:
    """Every entity of the coupling table with its place, known or not."""
    place = geo.select("entity_id", "station_name", "state", "region", "latitude", "longitude")
    return final.join(place, "entity_id", "left")


def all_gauges(final: DataFrame, geo: DataFrame) -> DataFrame:
    return gauges_with_geo(final, geo).select(
        "entity_id", "eia_location", "spearman_anom", "best_lag", "tier",
        "station_name", "state", "latitude", "longitude",
        classify.rho_class(F.col("spearman_anom")).alias("rho_class"),
        classify.rho_size(F.col("spearman_anom")).alias("rho_size"),
    )


def in_tier(final: DataFrame, tier: str = "tight") -> DataFrame:
    return final.filter(F.col("tier") == tier)


def tight_gauges(
    final: DataFrame, geo: DataFrame, locations: DataFrame, tier: str = "tight"
) -> DataFrame:
    """Entities of a tier with place and location names, strongest first."""
    named = locations.select("entity_id", "eia_location_name")
    return _strongest_first(
        gauges_with_geo(in_tier(final, tier), geo).join(named, "entity_id", "left").select(
            "entity_id", "eia_location", "eia_location_name", "state", "region", "station_name",
            "latitude", "longitude", "spearman_anom", "pearson_anom", "best_lag", "tier",
            "n_months",
        )
    )


def ranked_coupling(final: DataFrame, geo: DataFrame, tier: str = "tight") -> DataFrame:
    return _strongest_first(
        gauges_with_geo(in_tier(final, tier), geo).select(
            "entity_id", "station_name", "eia_location", "spearman_anom", "pearson_anom",
            "best_lag", "tier",
        )
    )


def gauge_series(pairs: DataFrame, entity_id: str | None = None) -> DataFrame:
    """Aligned months of one entity in order, or of all in no order."""
    rows = pairs.select(
        "entity_id", "period", "mean_flow_cfs", "generation_thousand_mwh", "confidence"
    )
    if entity_id is None:
        return rows
    return rows.filter(F.col("entity_id") == entity_id).orderBy("period")


def location_generation(
    pairs: DataFrame, locations: DataFrame, location: str | None = None
) -> DataFrame:
    """Monthly generation per entity of a location; one row per entity, not summed.

    Ordered for a single location only.
    """
    mapped = locations.select("entity_id", "eia_location")
    if location is not None:
        mapped = mapped.filter(F.col("eia_location") == location)
    rows = pairs.join(mapped, "entity_id").select(
        "entity_id", "eia_location", "period", "generation_thousand_mwh"
    )
    return rows if location is None else rows.orderBy("period", "entity_id")


def location_totals(pairs: DataFrame, locations: DataFrame) -> DataFrame:
    """Generation per location and month summed over its entities.

    Every entity carries the full value of its location, so the sum counts it once
    per entity; ``generation_once`` is the value itself.
    """
    rows = location_generation(pairs, locations)
    return rows.groupBy("eia_location", "period").agg(
        F.sum("generation_thousand_mwh").alias("generation_thousand_mwh"),
        F.max("generation_thousand_mwh").alias("generation_once"),
    )


def location_scores(pairs: DataFrame, locations: DataFrame) -> DataFrame:
    """Whole-series score of each location's monthly total."""
    totals = location_totals(pairs, locations)
    return totals.select(
        "eia_location", "period",
        whole_series_z("generation_thousand_mwh", ["eia_location"]).alias("gen_z"),
    )


def tight_scores(pairs: DataFrame, final: DataFrame, locations: DataFrame) -> DataFrame:
    """The location's scores for each entity of the tight tier: (entity_id, period, gen_z)."""
    scored = location_scores(pairs, locations).withColumnRenamed("eia_location", "location")
    return for_each_entity(scored, in_tier(final))


def flow_scores(pairs: DataFrame, entity_id: str | None = None) -> DataFrame:
    """De-seasonalised flow per entity and month."""
    rows = gauge_series(pairs, entity_id).withColumn("month", period_month(F.col("period")))
    return rows.select(
        "entity_id", "period", calendar_month_anomaly("mean_flow_cfs", ["entity_id"]).alias("flow_z")
    )


def overlay(
    pairs: DataFrame, final: DataFrame, locations: DataFrame, entity_id: str | None = None
) -> DataFrame:
    """Flow and location generation scores per month, with the co-movement flag.

    Entities outside the tight tier have no generation side.
    """
    return (
        flow_scores(pairs, entity_id)
        .join(tight_scores(pairs, final, locations), ["entity_id", "period"], "left")
        .select(
            "entity_id", "period", "flow_z", "gen_z",
            scores.moves_together(F.col("flow_z"), F.col("gen_z")).alias("together"),
        )
    )


def comovement_spans(overlaid: DataFrame) -> DataFrame:
    """Unbroken runs of co-movement, padded by a day on each side for display."""
    return true_spans(overlaid, ["entity_id"], "period", "together").select(
        "entity_id", "span_start", "span_end", "n_rows",
        F.date_sub(period_start(F.col("span_start")), 1).alias("x0"),
        F.date_add(period_start(F.col("span_end")), 1).alias("x1"),
    )


def next_month_pairs(
    pairs: DataFrame, final: DataFrame, locations: DataFrame, entity_id: str | None = None,
    months: int = 1,
) -> DataFrame:
    """Flow of a month beside the generation ``months`` later, by calendar."""
    later = tight_scores(pairs, final, locations).select(
        "entity_id", shift_period(F.col("period"), -months).alias("period"),
        F.col("gen_z").alias("gen_next_z"),
    )
    return (
        flow_scores(pairs, entity_id)
        .join(later, ["entity_id", "period"])
        .select("entity_id", "period", "flow_z", "gen_next_z")
        .dropna()
    )


def next_month_fit(scatter: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Least-squares line (from three pairs) and rank correlation per entity."""
    line = scatter.groupBy("entity_id").agg(
        F.count("*").alias("n"),
        F.regr_slope("gen_next_z", "flow_z").alias("slope"),
        F.regr_intercept("gen_next_z", "flow_z").alias("intercept"),
    )
    rho = rank_correlation(scatter, ["entity_id"], "flow_z", "gen_next_z").select(
        "entity_id", F.when(F.col("n") >= cfg.min_pairs, F.col("spearman")).alias("rho_lag")
    )
    drawn = F.col("n") >= 3
    return line.join(rho, "entity_id").select(
        "entity_id", "n",
        F.when(drawn, F.col("slope")).alias("slope"),
        F.when(drawn, F.col("intercept")).alias("intercept"),
        "rho_lag",
    )


def small_multiples(pairs: DataFrame, final: DataFrame, tier: str = "tight") -> DataFrame:
    """Scores of both series for every entity of a tier, in one pass."""
    rows = pairs.join(in_tier(final, tier).select("entity_id", "spearman_anom"), "entity_id")
    return rows.select(
        "entity_id", "period", "spearman_anom",
        whole_series_z("mean_flow_cfs", ["entity_id"]).alias("flow_z"),
        whole_series_z("generation_thousand_mwh", ["entity_id"]).alias("gen_z"),
    )


def coverage(pairs: DataFrame, n: int = 6) -> DataFrame:
    """Entities whose series reaches furthest."""
    return (
        pairs.groupBy("entity_id").agg(F.max("period").alias("max_period"))
        .orderBy(F.desc("max_period"), "entity_id").limit(n)
    )


def tier_changes(old: DataFrame, new: DataFrame, tier: str = "tight") -> DataFrame:
    """Entities that left or entered a tier between two coupling tables."""
    before, after = in_tier(old, tier), in_tier(new, tier)
    lost = only_in(before, after, "entity_id").withColumn("change", F.lit("lost"))
    gained = only_in(after, before, "entity_id").withColumn("change", F.lit("gained"))
    return lost.unionByName(gained)
