"""Every registered query: Spark side, output format, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import calendar, classify, regions, text
from tidemark.operators import baseline, coupling, daily, rollup, upsert
from tidemark.plans import build, dashboard, quality, series
from tidemark.plans import coupling as coupled
from tidemark.sources import landed, layers, sinks
from workload import tables as w
from workload.oracle import (
    compose, correlations_sql, formatted, formatted_sql, p_value_sql, whole_z_sql,
)
from workload.tables import CFG, DAY, ENTITY, METRIC, SPAN, TODAY, Tables


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    spec: str
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = Query(fn, spec, sql)
        return fn
    return keep


EVENT = CFG.extreme_z
DAY_SQL = f"DATE '{DAY}'"
SPAN_SQL = f"BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'"
DAILY = ("entity_id s, metric s, observed_at t, observation_count i, minimum d4, maximum d4, "
         "average d4, daily_change d4, rise_rate_3d d4, flow_percentile d6, anomaly_score d6, "
         "completeness_score d1, record_proximity d6, year i")
CATEGORY = ("date t, region s, metric s, entity_count i, event_count i, average_anomaly d6, "
            "extreme_entity_count i, year i")
RISERS = "date t, region s, metric s, rank i, entity_id s, station_name s, rise_rate_3d d4, value d4"
Z_CODE = """CASE WHEN {z} IS NULL THEN 6 WHEN {z} <= -2 THEN 0 WHEN {z} <= -1.5 THEN 1
WHEN {z} < 1.5 THEN 2 WHEN {z} < 2 THEN 3 WHEN {z} < 3 THEN 4 ELSE 5 END"""
PROXIMITY = """CASE WHEN {p} IS NULL THEN NULL WHEN {p} * 100 < 25 THEN 'far'
WHEN {p} * 100 < 75 THEN 'typical' WHEN {p} * 100 < 95 THEN 'near' ELSE 'at record' END"""


# -- builds ------------------------------------------------------------------

@query("b01_seasonal_baselines",
       "entity_id s, metric s, day_of_year i, mu d7, sigma d4, n_years i",
       "SELECT * FROM baselines")
def _(t: Tables) -> DataFrame:
    return baseline.seasonal_baselines(t.raw(), CFG)


@query("b02_daily_entity_metrics", DAILY, "SELECT * FROM daily")
def _(t: Tables) -> DataFrame:
    return daily.daily_entity_metrics(
        t.daily_stats(), baseline.seasonal_baselines(t.raw(), CFG), daily.newest_observed(t.raw()))


@query("b02_stored_daily_layer", DAILY, "SELECT * FROM daily")
def _(t: Tables) -> DataFrame:
    return t.daily()


@query("b03_category_metrics", CATEGORY, "SELECT * FROM category")
def _(t: Tables) -> DataFrame:
    return rollup.category_metrics(t.daily(), t.stations(), CFG)


@query("b03_category_risers", RISERS, "SELECT * FROM risers")
def _(t: Tables) -> DataFrame:
    return dashboard.risers(rollup.category_metrics(t.daily(), t.stations(), CFG))


@query("b04_flow_monthly", "entity_id s, period s, mean_flow_cfs d6, n_days i",
       "SELECT * FROM flow")
def _(t: Tables) -> DataFrame:
    return coupling.flow_monthly(t.daily(), CFG)


@query("b05_generation_base", "entity_id s, period s, generation_thousand_mwh d4",
       "SELECT * FROM generation_base")
def _(t: Tables) -> DataFrame:
    return t.generation_base()


@query("b06_extended_generation", "entity_id s, period s, generation_thousand_mwh d4",
       "SELECT * FROM generation")
def _(t: Tables) -> DataFrame:
    return t.generation()


@query("b07_aligned_pairs",
       "entity_id s, period s, mean_flow_cfs d6, generation_thousand_mwh d4, confidence s",
       "SELECT * FROM pairs")
def _(t: Tables) -> DataFrame:
    return coupling.aligned_pairs(
        coupling.flow_monthly(t.daily(), CFG), t.generation(), t.locations())


@query("b08_correlation_raw",
       "entity_id s, eia_location s, confidence s, n_months i, pearson_raw d6, pearson_raw_p d6, "
       "spearman_raw d6, spearman_raw_p d6, pearson_anom d6, pearson_anom_p d6, "
       "spearman_anom d6, spearman_anom_p d6, best_lag i, best_lag_corr d6",
       "SELECT * FROM correlation_raw")
def _(t: Tables) -> DataFrame:
    return coupling.correlation_raw(t.pairs(), t.baselines(), t.locations(), CFG)


@query("b08_correlation_final",
       "entity_id s, eia_location s, confidence s, n_months i, spearman_anom d6, "
       "spearman_anom_p d6, pearson_anom d6, best_lag i, tier s, decoupled b, significant b",
       "SELECT * FROM correlation_final")
def _(t: Tables) -> DataFrame:
    return t.correlation_final()


@query("b09_parsed_features",
       "source s, entity_id s, observed_at t, metric s, parameter_code s, value d4, unit s, "
       "latitude d4, longitude d4, approval_status s, qualifier s, payload_value s, raw_payload s",
       """
SELECT 'usgs_daily' AS source, entity_id, CAST(day AS DATE) AS observed_at,
       CASE code WHEN '00060' THEN 'streamflow' ELSE code END AS metric,
       code AS parameter_code, TRY_CAST(arg_max(text, payload) AS DOUBLE) AS value,
       'unit' AS unit, 40.5 AS latitude, CAST(user_id AS DOUBLE) AS longitude,
       'Provisional' AS approval_status, 'e' AS qualifier,
       arg_max(text, payload) AS payload_value, max(payload) AS raw_payload
FROM (SELECT *, '{"monitoring_location_id":"' || entity_id || '","time":"' || day
                || '","parameter_code":"' || code || '","value":"' || text
                || '","unit_of_measure":"unit","approval_status":"Provisional",'
                || '"qualifier":["e"],"time_series_id":"E-' || event_id || '"}' AS payload
      FROM (SELECT user_id, event_id, 'U-' || user_id AS entity_id,
                   strftime(ts, '%Y-%m-%d') AS day,
                   CASE event_type WHEN 'view' THEN '00060' ELSE event_type END AS code,
                   CASE event_type WHEN 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS text
            FROM events))
GROUP BY entity_id, user_id, day, code
""")
def _(t: Tables) -> DataFrame:
    rows = landed.observations(
        landed.parse_pages(t.pages(), "page", schemas.OBSERVATION_PAGE),
        F.lit(w.COLLECTED).cast("timestamp"))
    return rows.withColumns({
        "qualifier": F.concat_ws(";", "qualifier"),
        "payload_value": text.payload_field(F.col("raw_payload"), "$.value"),
    })


OBS = ("entity_id s, parameter_code s, observed_at t, value d4, approval_status s, qualifier s, "
       "raw_payload s, collected_at s")
STAMP = "%Y-%m-%d %H:%M:%S"


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "qualifier": F.concat_ws(";", "qualifier"),
        "collected_at": F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss"),
    })


@query("b09_latest_wins", OBS, f"""
SELECT entity_id, parameter_code, observed_at, value, approval_status, qualifier, raw_payload,
       strftime(collected_at, '{STAMP}') AS collected_at
FROM (SELECT *, 0 AS is_new FROM snapshot UNION ALL SELECT *, 1 FROM refetched)
QUALIFY row_number() OVER (PARTITION BY entity_id, parameter_code, observed_at
                           ORDER BY collected_at DESC, is_new DESC, raw_payload DESC) = 1
""")
def _(t: Tables) -> DataFrame:
    return _flat(upsert.latest_wins(t.snapshot(), t.refetched()))


def _upserted(t: Tables) -> DataFrame:
    empty = t.spark.createDataFrame([], schemas.RAW_OBSERVATIONS)
    return upsert.upsert(
        upsert.latest_wins(empty, t.snapshot()), upsert.unique_observations(t.refetched()))


@query("b10_upsert", OBS + ", action s, newly_approved b",
       f"SELECT * REPLACE (strftime(collected_at, '{STAMP}') AS collected_at) FROM upserted")
def _(t: Tables) -> DataFrame:
    return _flat(_upserted(t))


@query("b10_upsert_counts", "new i, updated i, unchanged i, provisional_to_approved i", """
SELECT count(*) FILTER (WHERE action = 'new') AS new,
       count(*) FILTER (WHERE action = 'updated') AS updated,
       count(*) FILTER (WHERE action = 'unchanged') AS unchanged,
       count(*) FILTER (WHERE newly_approved) AS provisional_to_approved
FROM upserted
""")
def _(t: Tables) -> DataFrame:
    return _upserted(t).agg(*upsert.upsert_counts())


@query("b10_synced_partitions", "metric s, year i, n_rows i", """
SELECT parameter_code AS metric, year(observed_at) AS year, count(*) AS n_rows
FROM upserted GROUP BY 1, 2
""")
def _(t: Tables) -> DataFrame:
    return sinks.partition_counts(t.raw_layer().raw())


@query("b11_stations",
       "entity_id s, station_name s, state s, region s, latitude d4, longitude d4, "
       "hydrologic_unit_code s, site_type s, agency_code s, drainage_area d4, "
       "first_year_of_record i, earliest_verified_year i", """
SELECT c.*, 41.25 AS latitude, 'Stream' AS site_type, 'X' AS agency_code, r.first_year_of_record,
       CASE WHEN r.first_year_of_record <= 2004 THEN 2004 END AS earliest_verified_year
FROM customer_regions c LEFT JOIN record_starts r USING (entity_id)
""")
def _(t: Tables) -> DataFrame:
    return landed.stations(t.station_features(), t.series_periods(), t.curated())


# -- one day -----------------------------------------------------------------

@query("q01_slice_of_day",
       "entity_id s, station_name s, region s, state s, latitude d4, longitude d4, metric s, "
       "average d4, anomaly_score d6, flow_percentile d6, rise_rate_3d d4, daily_change d4, "
       "completeness_score d1, record_proximity d6",
       f"SELECT * FROM placed WHERE observed_at = {DAY_SQL}")
def _(t: Tables) -> DataFrame:
    return dashboard.slice_of_day(t.daily(), t.stations(), None, DAY)


@query("q02_kpi_cards",
       "extreme_events_today i, riser_id s, riser_name s, riser_rate d4, riser_value d4, "
       "most_below_normal s, gauges_reporting i, total_gauges i, gap_rate d6, total_rows i, "
       "last_date t", f"""
SELECT (SELECT count(*) FROM placed WHERE metric = '{METRIC}' AND observed_at = {DAY_SQL}
        AND abs(anomaly_score) >= {EVENT}) AS extreme_events_today,
       r.entity_id AS riser_id, r.station_name AS riser_name, r.rise_rate_3d AS riser_rate,
       r.average AS riser_value,
       (SELECT region FROM placed WHERE metric = '{METRIC}' AND observed_at = {DAY_SQL}
        GROUP BY region HAVING avg(anomaly_score) IS NOT NULL
        ORDER BY avg(anomaly_score), region LIMIT 1) AS most_below_normal,
       (SELECT count(*) FROM placed WHERE metric = '{METRIC}' AND observed_at = {DAY_SQL}
        AND completeness_score > 0) AS gauges_reporting,
       (SELECT count(*) FROM placed WHERE metric = '{METRIC}' AND observed_at = {DAY_SQL})
         AS total_gauges,
       s.gap_rate, s.total_rows, s.last_date
FROM (SELECT * FROM placed WHERE metric = '{METRIC}' AND observed_at = {DAY_SQL}
      ORDER BY rise_rate_3d DESC NULLS LAST, entity_id LIMIT 1) r
CROSS JOIN (SELECT count(*) AS total_rows, max(observed_at) AS last_date,
                   avg(CASE WHEN completeness_score > 0 THEN 0.0 ELSE 1.0 END) AS gap_rate
            FROM daily WHERE metric = '{METRIC}') s
""")
def _(t: Tables) -> DataFrame:
    cards = dashboard.kpi_cards(t.daily(), t.stations(), METRIC, DAY, CFG)
    fields = {"riser_id": "entity_id", "riser_name": "station_name",
              "riser_rate": "rise_rate_3d", "riser_value": "value"}
    return cards.withColumns({k: F.col(f"fastest_riser.{v}") for k, v in fields.items()})


@query("q03_top_anomaly_dates",
       "date t, total_events i, total_extreme i, metric s, events i", """
SELECT c.date, d.total_events, d.total_extreme, c.metric, sum(c.event_count) AS events
FROM category c JOIN (
  SELECT date, sum(event_count) AS total_events, sum(extreme_entity_count) AS total_extreme
  FROM category GROUP BY date ORDER BY total_events DESC, date LIMIT 20) d USING (date)
GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    top = dashboard.top_anomaly_dates(t.category(), 20)
    return top.select("date", "total_events", "total_extreme",
                      F.explode("metrics_breakdown").alias("metric", "events"))


EXTREME = ("observed_at t, entity_id s, station_name s, region s, metric s, anomaly_score d6, "
           "average d4")


@query("q04_anomaly_breakdown", EXTREME, f"SELECT * FROM placed WHERE abs(anomaly_score) >= {EVENT}")
def _(t: Tables) -> DataFrame:
    return dashboard.anomaly_breakdown(t.daily(), t.stations(), None, CFG)


@query("q05_monthly_anomaly_counts",
       "year_month t, year i, month i, total_events i, total_extreme i, threshold d6, is_high b",
       """
SELECT m.*, s.threshold, m.total_events >= s.threshold AS is_high
FROM (SELECT date_trunc('month', date) AS year_month, year(date) AS year, month(date) AS month,
             sum(event_count) AS total_events, sum(extreme_entity_count) AS total_extreme
      FROM category GROUP BY 1, 2, 3) m
CROSS JOIN (SELECT avg(n) + stddev_samp(n) AS threshold
            FROM (SELECT sum(event_count) AS n FROM category
                  GROUP BY date_trunc('month', date))) s
""")
def _(t: Tables) -> DataFrame:
    return dashboard.monthly_anomaly_counts(t.category())


SIZES = """
SELECT *, CASE WHEN r IS NULL OR hi IS NULL OR hi <= lo THEN 8.0
               ELSE round_even(5.0 + 15.0 * (r - lo) / (hi - lo), 1) END AS marker_size
FROM (SELECT *, min(r) OVER k AS lo, max(r) OVER k AS hi
      FROM (SELECT *, CASE WHEN average >= 0 THEN sqrt(average) END AS r FROM {source})
      WINDOW k AS (PARTITION BY metric, observed_at))
"""


@query("q06_map_data",
       "entity_id s, station_name s, latitude d4, longitude d4, metric s, value d4, "
       "anomaly_score d6, flow_percentile d6, region s, state s, marker_size d1, z_code i",
       f"SELECT *, average AS value, {Z_CODE.format(z='anomaly_score')} AS z_code FROM ("
       + SIZES.format(source="placed") + f") WHERE observed_at = {DAY_SQL}")
def _(t: Tables) -> DataFrame:
    return dashboard.map_data(t.daily(), t.stations(), None, DAY)


@query("w14_marker_sizes", "entity_id s, metric s, observed_at t, marker_size d1",
       SIZES.format(source="daily"))
def _(t: Tables) -> DataFrame:
    return dashboard.marker_sizes(t.daily(), "average", ["metric", "observed_at"])


@query("q07_region_table",
       "region s, metric s, entity_count i, event_count i, average_anomaly d6, n_risers i", f"""
SELECT c.*, (SELECT count(*) FROM risers r WHERE r.date = c.date AND r.region = c.region
             AND r.metric = c.metric) AS n_risers
FROM category c WHERE c.date = {DAY_SQL}
""")
def _(t: Tables) -> DataFrame:
    return dashboard.region_table(t.category(), None, DAY).withColumn(
        "n_risers", F.size("fastest_risers"))


@query("q08_fastest_risers", RISERS, "SELECT * FROM risers")
def _(t: Tables) -> DataFrame:
    return dashboard.risers(t.category())


@query("q16_default_date", "default_date t", f"""
SELECT coalesce(
  (SELECT max(observed_at) FROM (
     SELECT observed_at, avg(CASE WHEN average IS NOT NULL THEN 1 ELSE 0 END) AS coverage
     FROM placed WHERE metric = '{METRIC}' GROUP BY 1)
   WHERE coverage >= 0.5 AND observed_at > last_day - 14), last_day) AS default_date
FROM (SELECT max(observed_at) AS last_day FROM daily WHERE metric = '{METRIC}')
""")
def _(t: Tables) -> DataFrame:
    return dashboard.default_date(t.daily(), t.stations(), CFG)


MODE = """
SELECT state, region FROM (SELECT state, region, count(*) AS n FROM stations GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY state ORDER BY n DESC, region) = 1
"""


@query("q17_region_states", "state s, region s, avg_z d6, n i, events i, code i", f"""
SELECT s.state, m.region, c.average_anomaly AS avg_z,
       CASE WHEN c.average_anomaly IS NOT NULL THEN c.entity_count ELSE 0 END AS n,
       CASE WHEN c.average_anomaly IS NOT NULL THEN c.event_count ELSE 0 END AS events,
       CASE WHEN m.region IS NULL THEN 7 ELSE {Z_CODE.format(z='c.average_anomaly')} END AS code
FROM (SELECT 'S-' || n_nationkey AS state FROM nation) s
LEFT JOIN ({MODE}) m USING (state)
LEFT JOIN (SELECT * FROM category WHERE metric = '{METRIC}' AND date = {DAY_SQL}) c
  ON c.region = m.region
""")
def _(t: Tables) -> DataFrame:
    states = t.given("nation").select(F.concat(F.lit("S-"), "n_nationkey").alias("state"))
    return dashboard.region_states(t.category(), t.stations(), states, METRIC, DAY)


# -- series ------------------------------------------------------------------

HYDRO = ("entity_id s, observed_at t, average d4, water_temp d4, anomaly_score d6, "
         "daily_change d4, rise_rate_3d d4, flow_percentile d6, completeness_score d1")
HYDRO_SQL = """
SELECT entity_id, observed_at, max(average) FILTER (WHERE metric = '{m}') AS average,
       CASE WHEN count(*) FILTER (WHERE metric = '{m}') > 0
            THEN max(average) FILTER (WHERE metric = 'discount') END AS water_temp,
       max(anomaly_score) FILTER (WHERE metric = '{m}') AS anomaly_score,
       max(daily_change) FILTER (WHERE metric = '{m}') AS daily_change,
       max(rise_rate_3d) FILTER (WHERE metric = '{m}') AS rise_rate_3d,
       max(flow_percentile) FILTER (WHERE metric = '{m}') AS flow_percentile,
       coalesce(max(completeness_score) FILTER (WHERE metric = '{m}'), 0.0) AS completeness_score
FROM (SELECT entity_id, observed_at, metric, average, anomaly_score, daily_change, rise_rate_3d,
             flow_percentile, completeness_score
      FROM daily WHERE metric IN ('{m}', 'discount')
                   AND observed_at BETWEEN DATE '{a}' AND DATE '{b}'
      UNION ALL
      SELECT entity_id, CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY))
                             AS DATE), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM stations)
GROUP BY entity_id, observed_at
"""
WHOLE = (SPAN[0].replace(year=1994, month=12), SPAN[1].replace(year=2001))


@query("q09_hydrograph", HYDRO, HYDRO_SQL.format(a=WHOLE[0], b=WHOLE[1], m=METRIC))
def _(t: Tables) -> DataFrame:
    return series.hydrograph(t.daily(), t.stations(), METRIC, *WHOLE, cfg=CFG)


@query("q10_baseline_band", "entity_id s, metric s, day_of_year i, mu d7, sigma d4",
       "SELECT * FROM baselines WHERE day_of_year BETWEEN 32 AND 335")
def _(t: Tables) -> DataFrame:
    span = SPAN[0].replace(month=2), SPAN[1].replace(month=11, day=30)
    return series.baseline_band(t.baselines(), *span)


@query("q11_banded_hydrograph",
       HYDRO + ", mu d7, sigma d4, lower_1s d4, upper_1s d4, lower_2s d4, upper_2s d4, "
       "is_event b, is_gap b, z_code i", f"""
SELECT h.*, b.mu, b.sigma, mu - sigma AS lower_1s, mu + sigma AS upper_1s,
       mu - 2 * sigma AS lower_2s, mu + 2 * sigma AS upper_2s,
       coalesce(abs(h.anomaly_score) >= {EVENT} AND h.average IS NOT NULL, false) AS is_event,
       h.completeness_score = 0 AS is_gap, {Z_CODE.format(z='h.anomaly_score')} AS z_code
FROM ({HYDRO_SQL.format(a=WHOLE[0], b=WHOLE[1], m=METRIC)}) h
LEFT JOIN (SELECT * FROM baselines WHERE metric = '{METRIC}') b
  ON h.entity_id = b.entity_id AND dayofyear(h.observed_at) = b.day_of_year
""")
def _(t: Tables) -> DataFrame:
    return series.banded_hydrograph(
        t.daily(), t.baselines(), t.stations(), METRIC, *WHOLE, cfg=CFG)


@query("a28_value_range", "entity_id s, y_min d4, y_max d4", f"""
SELECT h.entity_id, min(least(mu, mu - 2 * sigma, average)) AS y_min,
       max(greatest(mu, mu + 2 * sigma, average)) AS y_max
FROM ({HYDRO_SQL.format(a=SPAN[0], b=SPAN[1], m=METRIC)}) h
LEFT JOIN (SELECT * FROM baselines WHERE metric = '{METRIC}') b
  ON h.entity_id = b.entity_id AND dayofyear(h.observed_at) = b.day_of_year
GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    return series.value_range(series.banded_hydrograph(
        t.daily(), t.baselines(), t.stations(), METRIC, *SPAN, cfg=CFG))


@query("q12_raw_payload", "entity_id s, metric s, observed_at t, raw_payload s", """
SELECT entity_id, parameter_code AS metric, observed_at, raw_payload
FROM upserted WHERE observed_at = DATE '2024-01-18'
""")
def _(t: Tables) -> DataFrame:
    raw = t.raw_layer().raw()
    return series.raw_payload(raw, None, w.SNAPSHOT_END.replace(day=18))


FLASH = ("entity_id s, metric s, year i, region s, flashiness_index d6, n_days i, region_rank i, "
         "n_gauges i, flashiness_class s")


@query("q13_ranked_flashiness", FLASH, "SELECT * FROM ranked_flashiness")
def _(t: Tables) -> DataFrame:
    return series.ranked_flashiness(t.daily(), t.stations())


ONE_SQL = f"""
SELECT e.entity_id, {DAY.year} AS year, s.region, f.flashiness_index,
       coalesce(f.n_days, 0) AS n_days, f.region_rank, f.flashiness_class,
       (SELECT count(*) FROM flashiness p WHERE p.region = s.region AND p.metric = '{METRIC}'
        AND p.year = {DAY.year}) AS n_gauges
FROM (SELECT '{ENTITY}' AS entity_id) e LEFT JOIN stations s USING (entity_id)
LEFT JOIN (SELECT * FROM ranked_flashiness
           WHERE metric = '{METRIC}' AND year = {DAY.year}) f USING (entity_id)
"""


@query("q13_flashiness_of_one",
       "entity_id s, year i, region s, flashiness_index d6, n_days i, region_rank i, n_gauges i, "
       "flashiness_class s", ONE_SQL)
def _(t: Tables) -> DataFrame:
    return series.flashiness_of(t.daily(), t.stations(), ENTITY, METRIC, DAY.year)


CARDS = ("entity_id s, region s, average d4, flow_percentile d6, record_proximity d6, "
         "historical_max d4, flashiness_index d6, flashiness_rank i, n_gauges i, n_days i, "
         "flashiness_class s, proximity_class s")
CARDS_SQL = f"""
SELECT p.entity_id, p.region, p.average, p.flow_percentile, p.record_proximity,
       h.historical_max, f.flashiness_index, f.region_rank AS flashiness_rank, f.n_gauges,
       f.n_days, f.flashiness_class, {PROXIMITY.format(p='p.record_proximity')} AS proximity_class
FROM placed p
LEFT JOIN (SELECT * FROM ranked_flashiness WHERE metric = '{METRIC}' AND year = {DAY.year}) f
  USING (entity_id)
LEFT JOIN (SELECT entity_id, max(average) AS historical_max FROM daily
           WHERE metric = '{METRIC}' GROUP BY 1) h USING (entity_id)
WHERE p.metric = '{METRIC}' AND p.observed_at = {DAY_SQL}
"""


@query("q14_all_personality_cards", CARDS, CARDS_SQL)
def _(t: Tables) -> DataFrame:
    return series.all_personality_cards(t.daily(), t.stations(), METRIC, DAY)


@query("q14_personality_cards_of_one", CARDS, f"""
SELECT o.*, o.region_rank AS flashiness_rank, d.average, d.flow_percentile, d.record_proximity,
       (SELECT max(average) FROM daily WHERE metric = '{METRIC}' AND entity_id = '{ENTITY}')
         AS historical_max,
       {PROXIMITY.format(p='d.record_proximity')} AS proximity_class
FROM ({ONE_SQL}) o
LEFT JOIN (SELECT * FROM daily WHERE metric = '{METRIC}' AND observed_at = {DAY_SQL}) d
  USING (entity_id)
""")
def _(t: Tables) -> DataFrame:
    return series.personality_cards(t.daily(), t.stations(), ENTITY, METRIC, DAY)


@query("q15_previous_year", "entity_id s, metric s, observed_at t, average d4", """
SELECT entity_id, metric, CAST(observed_at + INTERVAL 1 YEAR AS DATE) AS observed_at, average
FROM daily WHERE year = 2000 AND average IS NOT NULL
""")
def _(t: Tables) -> DataFrame:
    return series.previous_year(t.daily(), None, 2001)


@query("q18_window_stats",
       "entity_id s, last_date t, average d4, anomaly_score d6, flow_percentile d6, "
       "record_proximity d6, proximity_class s", f"""
SELECT entity_id, max(observed_at) FILTER (WHERE average IS NOT NULL) AS last_date,
       arg_max(average, observed_at) AS average,
       arg_max(anomaly_score, observed_at) AS anomaly_score,
       arg_max(flow_percentile, observed_at) AS flow_percentile,
       arg_max(record_proximity, observed_at) FILTER (WHERE average IS NOT NULL)
         AS record_proximity,
       {PROXIMITY.format(p='record_proximity')} AS proximity_class
FROM (SELECT entity_id, observed_at, average, anomaly_score, flow_percentile, record_proximity
      FROM daily WHERE metric = '{METRIC}' AND observed_at {SPAN_SQL}) x
GROUP BY 1
""".replace(PROXIMITY.format(p="record_proximity"),
            PROXIMITY.format(p="arg_max(record_proximity, observed_at) "
                               "FILTER (WHERE average IS NOT NULL)")))
def _(t: Tables) -> DataFrame:
    return series.window_stats(t.daily(), METRIC, *SPAN)


# -- coupling ----------------------------------------------------------------

GEO = """
SELECT c.*, s.station_name, s.state, s.region, s.latitude, s.longitude, l.eia_location_name
FROM correlation_final c LEFT JOIN stations s USING (entity_id)
LEFT JOIN (SELECT entity_id, eia_location_name FROM locations) l USING (entity_id)
"""


@query("q19_tight_gauges",
       "entity_id s, eia_location s, eia_location_name s, state s, region s, station_name s, "
       "latitude d4, longitude d4, spearman_anom d6, pearson_anom d6, best_lag i, tier s, "
       "n_months i", f"SELECT * FROM ({GEO}) WHERE tier = 'tight'")
def _(t: Tables) -> DataFrame:
    return coupled.tight_gauges(t.correlation_final(), t.stations(), t.locations())


@query("q20_ranked_coupling",
       "entity_id s, station_name s, eia_location s, spearman_anom d6, pearson_anom d6, "
       "best_lag i, tier s", f"SELECT * FROM ({GEO}) WHERE tier = 'moderate'")
def _(t: Tables) -> DataFrame:
    return coupled.ranked_coupling(t.correlation_final(), t.stations(), "moderate")


@query("q21_gauge_series",
       "entity_id s, period s, mean_flow_cfs d6, generation_thousand_mwh d4, confidence s",
       "SELECT * FROM pairs")
def _(t: Tables) -> DataFrame:
    return coupled.gauge_series(t.pairs())


@query("q22_location_generation",
       "entity_id s, eia_location s, period s, generation_thousand_mwh d4",
       "SELECT p.*, l.eia_location FROM pairs p JOIN locations l USING (entity_id)")
def _(t: Tables) -> DataFrame:
    return coupled.location_generation(t.pairs(), t.locations())


@query("a17_location_totals",
       "eia_location s, period s, generation_thousand_mwh d4, generation_once d4",
       "SELECT * FROM location_totals")
def _(t: Tables) -> DataFrame:
    return coupled.location_totals(t.pairs(), t.locations())


@query("q23_all_gauges",
       "entity_id s, eia_location s, spearman_anom d6, best_lag i, tier s, station_name s, "
       "state s, latitude d4, longitude d4, rho_class s, rho_size d4", f"""
SELECT *, CASE WHEN abs(spearman_anom) >= 0.66 THEN 'strong'
               WHEN abs(spearman_anom) >= 0.58 THEN 'mid'
               WHEN spearman_anom IS NOT NULL THEN 'weak' END AS rho_class,
       6.0 + 8.0 * (abs(spearman_anom) - 0.5) / 0.25 AS rho_size
FROM ({GEO})
""")
def _(t: Tables) -> DataFrame:
    return coupled.all_gauges(t.correlation_final(), t.stations())


@query("q24_overlay", "entity_id s, period s, flow_z d6, gen_z d6, together b",
       "SELECT * FROM overlay")
def _(t: Tables) -> DataFrame:
    return coupled.overlay(t.pairs(), t.correlation_final(), t.locations())


@query("q24_comovement_spans", "entity_id s, span_start s, span_end s, n_rows i, x0 t, x1 t", """
SELECT entity_id, min(period) AS span_start, max(period) AS span_end, count(*) AS n_rows,
       CAST(min(period) || '-01' AS DATE) - 1 AS x0, CAST(max(period) || '-01' AS DATE) + 1 AS x1
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period)
              - row_number() OVER (PARTITION BY entity_id, together ORDER BY period) AS island
      FROM overlay) WHERE together GROUP BY entity_id, island
""")
def _(t: Tables) -> DataFrame:
    return coupled.comovement_spans(
        coupled.overlay(t.pairs(), t.correlation_final(), t.locations()))


@query("q25_next_month_pairs", "entity_id s, period s, flow_z d6, gen_next_z d6",
       "SELECT * FROM next_month")
def _(t: Tables) -> DataFrame:
    return coupled.next_month_pairs(t.pairs(), t.correlation_final(), t.locations())


@query("q25_next_month_fit", "entity_id s, n i, slope d6, intercept d6, rho_lag d6", f"""
SELECT a.entity_id, a.n, CASE WHEN a.n >= 3 THEN a.slope END AS slope,
       CASE WHEN a.n >= 3 THEN a.intercept END AS intercept,
       CASE WHEN r.n >= 5 THEN r.spearman END AS rho_lag
FROM (SELECT entity_id, count(*) AS n, regr_slope(gen_next_z, flow_z) AS slope,
             regr_intercept(gen_next_z, flow_z) AS intercept FROM next_month GROUP BY 1) a
JOIN ({correlations_sql('next_month', 'entity_id', 'flow_z', 'gen_next_z')}) r USING (entity_id)
""")
def _(t: Tables) -> DataFrame:
    return coupled.next_month_fit(
        coupled.next_month_pairs(t.pairs(), t.correlation_final(), t.locations()), CFG)


@query("q26_small_multiples",
       "entity_id s, period s, spearman_anom d6, flow_z d6, gen_z d6", f"""
SELECT p.entity_id, p.period, t.spearman_anom,
       {whole_z_sql('p.mean_flow_cfs', 'p.entity_id')} AS flow_z,
       {whole_z_sql('p.generation_thousand_mwh', 'p.entity_id')} AS gen_z
FROM pairs p JOIN tight t USING (entity_id)
""")
def _(t: Tables) -> DataFrame:
    return coupled.small_multiples(t.pairs(), t.correlation_final())


@query("w06_lag_scan", "entity_id s, lag i, n i, pearson d6, spearman d6",
       "SELECT * FROM corr_lagged")
def _(t: Tables) -> DataFrame:
    scan = coupling.correlation_scan(coupling.anomalies(t.pairs(), t.baselines(), CFG), CFG)
    return scan.filter(F.col("pairing") != coupling.RAW_PAIRING).withColumnRenamed("pairing", "lag")


@query("w15_adjusted_significance",
       "entity_id s, n i, spearman d6, rho1 d6, n_eff d4, p_adjusted d6", f"""
SELECT entity_id, n, spearman, rho1, n_eff, {p_value_sql('spearman', '(n_eff - 2)')} AS p_adjusted
FROM (SELECT c.entity_id, c.n, c.spearman, r.rho1, c.n * (1 - r.rho1) / (1 + r.rho1) AS n_eff
      FROM corr_flow_anom c JOIN (
        SELECT entity_id, corr(anomaly_flow, before) AS rho1 FROM (
          SELECT entity_id, anomaly_flow,
                 lag(anomaly_flow) OVER (PARTITION BY entity_id ORDER BY period) AS before
          FROM anomalies WHERE anomaly_flow IS NOT NULL AND anomaly_gen IS NOT NULL)
        WHERE before IS NOT NULL GROUP BY 1) r USING (entity_id))
""")
def _(t: Tables) -> DataFrame:
    return coupling.adjusted_significance(t.pairs(), t.baselines(), CFG)


@query("a13_monthly_climatology", "entity_id s, month i, mu_month d4, sigma_month d4",
       "SELECT * FROM climatology")
def _(t: Tables) -> DataFrame:
    return coupling.monthly_climatology(t.baselines(), METRIC)


@query("a15_hourly_to_daily", "day t, mean_mw d4",
       "SELECT CAST(ts AS DATE) AS day, avg(value) AS mean_mw FROM hourly GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return coupling.hourly_to_daily(t.hourly())


@query("a23_coverage", "entity_id s, max_period s", """
SELECT entity_id, max(period) AS max_period FROM pairs GROUP BY 1
ORDER BY max_period DESC, entity_id LIMIT 6
""")
def _(t: Tables) -> DataFrame:
    return coupled.coverage(t.pairs())


@query("a22_tier_frequency", "tier s, confidence s, n i",
       "SELECT tier, confidence, count(*) AS n FROM correlation_final GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return dashboard.frequency(t.correlation_final(), "tier", "confidence")


# -- single operators on whole tables ----------------------------------------

@query("a01_daily_stats",
       "entity_id s, metric s, observed_at t, observation_count i, minimum d4, maximum d4, "
       "average d4", "SELECT * FROM stats")
def _(t: Tables) -> DataFrame:
    return t.daily_stats()


@query("w01_percentile", "entity_id s, metric s, observed_at t, flow_percentile d6",
       "SELECT * FROM ranked_stats")
def _(t: Tables) -> DataFrame:
    return daily.with_percentile(t.daily_stats())


@query("a05_dataset_stats", "metric s, total_rows i, last_date t, gap_rate d6", """
SELECT metric, count(*) AS total_rows, max(observed_at) AS last_date,
       avg(CASE WHEN completeness_score > 0 THEN 0.0 ELSE 1.0 END) AS gap_rate
FROM daily GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    return dashboard.dataset_stats(t.daily())


@query("a29_dataset_totals", "total_rows i, latest_date t, n_stations i", """
SELECT count(*) AS total_rows, max(observed_at) AS latest_date,
       (SELECT count(*) FROM stations) AS n_stations FROM daily
""")
def _(t: Tables) -> DataFrame:
    return dashboard.dataset_totals(t.daily(), t.stations())


@query("a06_all_time_max", "entity_id s, metric s, historical_max d4",
       "SELECT entity_id, metric, max(average) AS historical_max FROM daily GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return series.all_time_max(t.daily())


@query("a08_events_by_day_and_metric", "date t, metric s, events i, extreme i", """
SELECT date, metric, sum(event_count) AS events, sum(extreme_entity_count) AS extreme
FROM category GROUP BY 1, 2
""")
def _(t: Tables) -> DataFrame:
    return dashboard.events_by_day_and_metric(t.category())


@query("a21_most_frequent_region", "state s, region s", MODE)
def _(t: Tables) -> DataFrame:
    return dashboard.most_frequent(t.stations(), "state", "region")


@query("a21_most_frequent_segment", "c_nationkey i, c_mktsegment s", """
SELECT c_nationkey, c_mktsegment
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1
""")
def _(t: Tables) -> DataFrame:
    return dashboard.most_frequent(t.given("customer"), "c_nationkey", "c_mktsegment")


@query("a22_region_frequency", "region s, n i",
       "SELECT region, count(*) AS n FROM customer_regions GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return dashboard.frequency(
        landed.stations(t.station_features(), t.series_periods(), t.curated()), "region")


@query("a24_record_starts", "entity_id s, first_year_of_record i", "SELECT * FROM record_starts")
def _(t: Tables) -> DataFrame:
    return landed.record_starts(t.series_periods())


@query("a27_coverage_by_day", "observed_at t, coverage d6", f"""
SELECT observed_at, avg(CASE WHEN average IS NOT NULL THEN 1 ELSE 0 END) AS coverage
FROM placed WHERE metric = '{METRIC}'
  AND observed_at > (SELECT max(observed_at) FROM daily WHERE metric = '{METRIC}') - 14
GROUP BY 1
""")
def _(t: Tables) -> DataFrame:
    return dashboard.coverage_by_day(t.daily(), t.stations(), METRIC, 14)


@query("u01_unique_observations", OBS, f"""
SELECT * REPLACE (strftime(collected_at, '{STAMP}') AS collected_at) FROM events_raw
QUALIFY row_number() OVER (PARTITION BY entity_id, parameter_code, observed_at
                           ORDER BY raw_payload DESC, collected_at DESC, value DESC) = 1
""")
def _(t: Tables) -> DataFrame:
    return _flat(upsert.unique_observations(t.events_raw()))


@query("u08_missing_members", "user_id i", """
SELECT c_custkey AS user_id FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events)
""")
def _(t: Tables) -> DataFrame:
    return upsert.only_in(
        t.given("customer").select(F.col("c_custkey").alias("user_id")), t.given("events"),
        "user_id")


@query("u07_tier_changes", "entity_id s, change s", """
SELECT coalesce(r.entity_id, a.entity_id) AS entity_id,
       CASE WHEN a.entity_id IS NULL THEN 'lost' ELSE 'gained' END AS change
FROM (SELECT entity_id FROM correlation_raw WHERE abs(spearman_raw) >= 0.3) r
FULL OUTER JOIN (SELECT entity_id FROM correlation_raw WHERE abs(spearman_anom) >= 0.3) a
  ON r.entity_id = a.entity_id
WHERE r.entity_id IS NULL OR a.entity_id IS NULL
""")
def _(t: Tables) -> DataFrame:
    rows = t.correlation_raw()

    def tiers(c: str) -> DataFrame:
        return rows.select("entity_id", F.when(F.abs(c) >= 0.3, "tight").alias("tier"))

    return coupled.tier_changes(tiers("spearman_raw"), tiers("spearman_anom"))


@query("f06_year_chunks", "o_orderkey i, chunk_start t, chunk_end t", """
SELECT o_orderkey, CAST(s AS DATE) AS chunk_start,
       least(CAST(s + INTERVAL 2 YEAR AS DATE) - 1, DATE '2004-02-29') AS chunk_end
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d0,
             CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 YEAR AS DATE) AS d1 FROM orders) o,
     LATERAL (SELECT d0 AS s UNION ALL
              SELECT CAST(unnest(generate_series(d1, DATE '2004-02-29', INTERVAL 2 YEAR)) AS DATE)) c
""")
def _(t: Tables) -> DataFrame:
    spans = t.given("orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("a"),
        F.to_date(F.lit("2004-02-29")).alias("b"))
    return calendar.year_chunks(spans, "a", "b", 2)


@query("f07_look_back", "o_orderkey i, name s, first_day t", """
SELECT o_orderkey, CASE WHEN d <= 31 THEN '1m' WHEN d <= 95 THEN '3m' WHEN d <= 190 THEN '6m'
                        WHEN d <= 370 THEN '1y' ELSE 'all' END AS name,
       CASE name WHEN '1m' THEN DATE '2001-11-10' - 29 WHEN '3m' THEN DATE '2001-11-10' - 89
                 WHEN '6m' THEN DATE '2001-11-10' - 181 WHEN '1y' THEN DATE '2001-11-10' - 364
                 ELSE DATE '1995-01-01' END AS first_day
FROM (SELECT o_orderkey, DATE '2001-11-10' - CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def _(t: Tables) -> DataFrame:
    end = F.lit(TODAY)
    return t.given("orders").select(
        "o_orderkey", calendar.span_name(F.to_date("o_orderdate"), end).alias("name")
    ).withColumn("first_day", calendar.lookback_start(F.col("name"), end, CFG.baseline_start))


@query("f05_shifted_periods", "o_orderkey i, before s, after s, doy_month i, next_year t", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 14 MONTH, '%Y-%m') AS before,
       strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') AS after,
       month(DATE '2001-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INTEGER)) AS doy_month,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS next_year
FROM orders
""")
def _(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    p = calendar.period(day)
    return t.given("orders").select(
        "o_orderkey", calendar.shift_period(p, -14).alias("before"),
        calendar.shift_period(p, 1).alias("after"),
        calendar.doy_month(F.dayofyear(day)).alias("doy_month"),
        calendar.plus_years(day, 1).alias("next_year"))


@query("f10_labels", "s_suppkey i, site s, short s", """
SELECT s_suppkey, 'USGS-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS site,
       CASE WHEN length(s_name) <= 12 THEN s_name ELSE rtrim(substr(s_name, 1, 11)) || '…' END
         AS short
FROM supplier
""")
def _(t: Tables) -> DataFrame:
    code = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
    spelled = F.concat(F.when(F.col("s_acctbal") > 0, " usgs-").otherwise(""), code)
    return t.given("supplier").select(
        "s_suppkey", text.site_id(spelled).alias("site"), text.ellipsis(F.col("s_name"), 12).alias("short"))


@query("f11_z_code_frequency", "metric s, z_code i, n i",
       f"SELECT metric, {Z_CODE.format(z='anomaly_score')} AS z_code, count(*) AS n "
       "FROM daily GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    coded = t.daily().withColumn("z_code", classify.z_code(F.col("anomaly_score")))
    return dashboard.frequency(coded, "metric", "z_code")


@query("f13_proximity_frequency", "metric s, proximity_class s, n i", f"""
SELECT metric, {PROXIMITY.format(p='record_proximity')} AS proximity_class, count(*) AS n
FROM daily GROUP BY 1, 2
""")
def _(t: Tables) -> DataFrame:
    coded = t.daily().withColumn(
        "proximity_class", classify.proximity_class(F.col("record_proximity") * 100))
    return dashboard.frequency(coded, "metric", "proximity_class")


@query("f16_customer_regions", "c_custkey i, region s", """
SELECT c_custkey, coalesce(r.region, 'Unknown') AS region FROM customer
LEFT JOIN state_regions r ON r.code = lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0')
""")
def _(t: Tables) -> DataFrame:
    code = F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")
    return t.given("customer").select(
        "c_custkey", regions.region_of(F.lit(None).cast("string"), code).alias("region"))


@query("f18_payload_fields", "event_id i, k s, is_json b, text_is_json b", """
SELECT event_id, props ->> '$.k' AS k, json_valid(props) AS is_json, false AS text_is_json
FROM events
""")
def _(t: Tables) -> DataFrame:
    return t.given("events").select(
        "event_id", text.payload_field(F.col("props"), "$.k").alias("k"),
        text.payload_is_json(F.col("props")).alias("is_json"),
        text.payload_is_json(F.concat(F.lit("{"), "event_type")).alias("text_is_json"))


@query("p13_entity_names", "entity_id s, label s", """
SELECT DISTINCT 'N-' || c_custkey AS entity_id, coalesce(s.station_name, 'N-' || c_custkey) AS label
FROM customer LEFT JOIN stations s ON s.entity_id = 'N-' || c_custkey
""")
def _(t: Tables) -> DataFrame:
    ids = t.given("customer").select(F.concat(F.lit("N-"), "c_custkey").alias("entity_id"))
    return series.entity_names(ids, t.stations())


@query("s09_sql_views", "region s, metric s, n i, mean_z d6", """
SELECT region, metric, count(*) AS n, avg(anomaly_score) AS mean_z FROM placed GROUP BY 1, 2
""")
def _(t: Tables) -> DataFrame:
    layers.register(tm_daily=t.daily(), tm_stations=t.stations())
    return t.spark.sql("""
        SELECT s.region, d.metric, count(*) AS n, avg(d.anomaly_score) AS mean_z
        FROM tm_daily d JOIN tm_stations s USING (entity_id) GROUP BY s.region, d.metric
    """)


@query("s05_csv_dimension", "entity_id s, station_name s, region s, latitude d4, longitude d4",
       "SELECT * FROM stations")
def _(t: Tables) -> DataFrame:
    path = t.store.path("stations_csv")
    sinks.write_csv(schemas.conform(
        t.stations().withColumns({
            c: F.lit(None) for c in schemas.columns(schemas.STATIONS)
            if c not in t.stations().columns}), schemas.STATIONS), path)
    return layers.read_dimension(t.spark, path, schemas.STATIONS)


@query("s04_window_years", "metric s, year i, n i, days i", """
SELECT metric, year, count(*) AS n, count(DISTINCT observed_at) AS days
FROM daily WHERE year BETWEEN 1999 AND 2000 GROUP BY 1, 2
""")
def _(t: Tables) -> DataFrame:
    rows = layers.read_years(t.daily(), SPAN[0].replace(year=1999), SPAN[1])
    return rows.groupBy("metric", "year").agg(
        F.count("*").alias("n"), F.countDistinct("observed_at").alias("days"))


@query("k01_partition_counts", "metric s, year i, n_rows i",
       "SELECT metric, year, count(*) AS n_rows FROM daily GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return sinks.partition_counts(t.daily())


@query("k02_category_partition_counts", "metric s, year i, n_rows i",
       "SELECT metric, year, count(*) AS n_rows FROM category GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return sinks.partition_counts(t.category())


@query("k07_exported_history",
       "entity_id s, metric s, observed_at t, value d4, approval_status s, qualifier s, "
       "raw_payload s", """
SELECT entity_id, parameter_code AS metric, observed_at, value, approval_status,
       nullif(qualifier, '') AS qualifier, raw_payload
FROM upserted WHERE entity_id = 'U-7' AND parameter_code = 'click'
""")
def _(t: Tables) -> DataFrame:
    path = t.store.path("exported_csv")
    rows = sinks.export_history(
        t.raw_layer().raw().select(*schemas.columns(schemas.RAW_OBSERVATIONS)), "U-7", "click")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return t.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


CHECKS = "check s, subject s, observed d6, status s"


@query("d01_health_report", CHECKS, f"""
SELECT 'row_count' AS check, 'raw_observations' AS subject, count(*) AS observed,
       CASE WHEN count(*) > 0 THEN 'ok' ELSE 'fail' END AS status FROM raw
UNION ALL SELECT 'row_count', 'daily_entity_metrics', count(*),
       CASE WHEN count(*) > 0 THEN 'ok' ELSE 'fail' END FROM daily
UNION ALL SELECT 'row_count', 'daily_category_metrics', count(*),
       CASE WHEN count(*) > 0 THEN 'ok' ELSE 'fail' END FROM category
UNION ALL SELECT 'identity_nulls', c, n, CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END FROM (
  SELECT 'entity_id' AS c, count(*) FILTER (WHERE entity_id IS NULL) AS n FROM raw
  UNION ALL SELECT 'observed_at', count(*) FILTER (WHERE observed_at IS NULL) FROM raw
  UNION ALL SELECT 'metric', count(*) FILTER (WHERE metric IS NULL) FROM raw)
UNION ALL SELECT 'value_null_share', 'value', s, CASE WHEN s <= 0.02 THEN 'ok' ELSE 'fail' END
  FROM (SELECT avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS s FROM raw)
UNION ALL SELECT 'days_old', 'observed_at', a, CASE WHEN a <= 3 THEN 'ok' ELSE 'warn' END
  FROM (SELECT DATE '{TODAY}' - max(observed_at) AS a FROM raw)
UNION ALL SELECT 'missing_metric', 'metric', n, CASE WHEN n = 0 THEN 'ok' ELSE 'fail' END
  FROM (SELECT count(*) AS n FROM (VALUES ('price'), ('quantity'), ('discount'), ('tax')) v(m)
        WHERE m NOT IN (SELECT metric FROM raw))
UNION ALL SELECT 'missing_entity_id', 'entity_id', n, CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END
  FROM (SELECT count(*) AS n FROM stations WHERE entity_id NOT IN (SELECT entity_id FROM raw))
UNION ALL SELECT 'lacks_metric', m, 0, 'fail'
  FROM (VALUES ('price'), ('quantity'), ('discount'), ('tax')) v(m)
  WHERE m NOT IN (SELECT metric FROM raw)
UNION ALL SELECT 'lacks_entity_id', entity_id, 0, 'warn'
  FROM stations WHERE entity_id NOT IN (SELECT entity_id FROM raw)
""")
def _(t: Tables) -> DataFrame:
    return quality.health_report(
        t.raw(), t.daily(), t.category(), t.stations(), TODAY, CFG)


@query("d02_stored_profile", "entity_id s, metric s, n i, no_date i, no_value i, newest t", """
SELECT entity_id, parameter_code AS metric, count(*) AS n, 0 AS no_date,
       count(*) FILTER (WHERE value IS NULL) AS no_value, max(observed_at) AS newest
FROM upserted GROUP BY 1, 2
""")
def _(t: Tables) -> DataFrame:
    """What the checks start from, kept up to date by the upserts instead of read from all rows."""
    return t.raw_layer().profile()


@query("st1_upsert_stream", OBS, """
SELECT * REPLACE (strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at) FROM events_raw
QUALIFY row_number() OVER (PARTITION BY entity_id, parameter_code, observed_at
                           ORDER BY collected_at DESC, raw_payload DESC, value DESC) = 1
""")
def _(t: Tables) -> DataFrame:
    """All events landed as files, streamed into a raw layer of their own."""
    from tidemark.streaming.landing import landed_observations, upsert_stream

    def load() -> None:
        t.events_raw().write.mode("overwrite").parquet(t.store.path("landing"))
        stream = landed_observations(t.spark, t.store.path("landing"))
        target = build.Store(t.spark, t.store.path("streamed"))
        upsert_stream(stream, target, t.store.path("stream_progress")).awaitTermination()

    t._once("streamed", load)
    return _flat(build.Store(t.spark, t.store.path("streamed")).raw())


PAGE_EVENTS = """
SELECT *, '{"monitoring_location_id":"' || entity_id || '","time":"' || day || '","parameter_code":"'
       || code || '","value":"' || text || '","unit_of_measure":"unit","approval_status":"Provisional",'
       || '"qualifier":["e"],"time_series_id":"E-' || event_id || '"}' AS payload
FROM (SELECT event_id, user_id, 'U-' || user_id AS entity_id, strftime(ts, '%Y-%m-%d') AS day,
             CASE event_type WHEN 'view' THEN '00060' ELSE event_type END AS code,
             CASE event_type WHEN 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS text
      FROM events)
"""


@query("st1_page_stream",
       "source s, entity_id s, observed_at t, metric s, parameter_code s, value d4, latitude d4, longitude d4, "
       "approval_status s, qualifier s, raw_payload s", f"""
SELECT 'usgs_daily' AS source, entity_id, CAST(day AS DATE) AS observed_at,
       CASE code WHEN '00060' THEN 'streamflow' ELSE code END AS metric, code AS parameter_code,
       TRY_CAST(arg_max(text, payload) AS DOUBLE) AS value, 40.5 AS latitude,
       CAST(user_id AS DOUBLE) AS longitude, 'Provisional' AS approval_status, 'e' AS qualifier,
       max(payload) AS raw_payload
FROM ({PAGE_EVENTS}) WHERE event_id % 50 > 2 GROUP BY entity_id, user_id, day, code
""")
def _(t: Tables) -> DataFrame:
    """Landed pages, some of them faulty, streamed into a raw layer of their own."""
    return _flat(t.page_stream().raw())


@query("st1_rejected_pages", "reason s, content s, n i", f"""
SELECT CASE event_id % 50 WHEN 0 THEN 'malformed page' WHEN 1 THEN 'no date' ELSE 'no entity' END AS reason,
       CASE event_id % 50 WHEN 0 THEN left('{{"features":[{{"properties":' || payload, 60)
            WHEN 1 THEN replace(payload, '"time":"' || day || '",', '')
            ELSE replace(payload, '"monitoring_location_id":"' || entity_id || '",', '') END AS content, count(*) AS n
FROM ({PAGE_EVENTS}) WHERE event_id % 50 <= 2 GROUP BY 1, 2
""")
def _(t: Tables) -> DataFrame:
    """What the same stream put aside."""
    return t.page_stream().rejected().groupBy("reason", "content").agg(F.count("*").alias("n"))


# -- driver contract ---------------------------------------------------------

def spark_query(name: str) -> Callable:
    q = QUERIES[name]

    def run(spark, sf_dir: str) -> DataFrame:
        return formatted(q.build(w.tables(spark, sf_dir)), q.spec)

    return run


def oracle_query(name: str) -> str:
    q = QUERIES[name]
    return compose(formatted_sql(q.sql, q.spec))
