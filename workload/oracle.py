"""Named SQL building blocks for the oracle, and the shared output format.

``compose`` puts the blocks a statement mentions in front of it, in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.regions import STATES
from workload.tables import CFG

# -- output format -----------------------------------------------------------
# "name kind" items: s text, t date, b boolean, i integer, dK double rounded to K.


def _items(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split()) for item in spec.split(",")]


def formatted(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _items(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind.startswith("d"):
            c = F.round(c.cast("double"), int(kind[1:])) + 0.0
        out.append(c.alias(name))
    return df.select(*out)


def formatted_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _items(spec):
        c = f'"{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "t":
            c = f"CAST({c} AS DATE)"
        elif kind.startswith("d"):
            c = f"round(CAST({c} AS DOUBLE), {kind[1:]}) + 0.0"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS answer"


# -- inputs ------------------------------------------------------------------

BLOCKS: dict[str, str] = {}

BLOCKS["raw"] = """
SELECT 'N-' || s_nationkey AS entity_id, m.metric, CAST(l_shipdate AS DATE) AS observed_at,
       CASE m.metric WHEN 'price' THEN floor(l_extendedprice)
                     WHEN 'quantity' THEN l_quantity
                     ELSE round(l_discount * 100) END AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
CROSS JOIN (VALUES ('price'), ('quantity'), ('discount')) AS m(metric)
"""
BLOCKS["stations"] = """
SELECT 'N-' || n_nationkey AS entity_id, n_name AS station_name,
       'S-' || (n_nationkey * n_nationkey % 7) AS state, r_name AS region,
       25.0 + n_nationkey AS latitude, 2.0 * n_nationkey - 120.0 AS longitude
FROM nation JOIN region ON n_regionkey = r_regionkey
"""
BLOCKS["locations"] = """
SELECT 'N-' || n_nationkey AS entity_id, 'L-' || (n_nationkey % 20) AS eia_location,
       'Location ' || (n_nationkey % 20) AS eia_location_name,
       CASE WHEN n_nationkey < 20 THEN 'high' ELSE 'low' END AS confidence
FROM nation
"""
BLOCKS["monthly"] = """
SELECT 'L-' || (s_nationkey % 20) AS location, strftime(l_shipdate, '%Y-%m') AS period,
       sum(floor(l_extendedprice)) / 1000.0 AS generation_thousand_mwh
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
"""
BLOCKS["hourly"] = """
SELECT date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1
"""
BLOCKS["events_raw"] = """
SELECT 'U-' || user_id AS entity_id, CAST(ts AS DATE) AS observed_at, ts AS collected_at,
       event_type AS metric, event_type AS parameter_code, value,
       CASE WHEN hour(ts) >= 12 THEN 'Approved' ELSE 'Provisional' END AS approval_status,
       CASE WHEN value < 5 THEN 'low' WHEN value > 150 THEN 'high;e' ELSE '' END AS qualifier,
       props AS raw_payload
FROM events
"""
BLOCKS["snapshot"] = """
SELECT * FROM events_raw WHERE hour(collected_at) < 12 AND observed_at < DATE '2024-01-21'
"""
BLOCKS["refetched"] = "SELECT * FROM events_raw WHERE observed_at >= DATE '2024-01-15'"
BLOCKS["old_rows"] = """
SELECT * FROM snapshot QUALIFY row_number() OVER (
  PARTITION BY entity_id, parameter_code, observed_at
  ORDER BY collected_at DESC, raw_payload DESC) = 1
"""
BLOCKS["new_rows"] = """
SELECT * FROM refetched QUALIFY row_number() OVER (
  PARTITION BY entity_id, parameter_code, observed_at
  ORDER BY raw_payload DESC, collected_at DESC, value DESC) = 1
"""
BLOCKS["upserted"] = """
SELECT coalesce(o.entity_id, n.entity_id) AS entity_id,
       coalesce(o.parameter_code, n.parameter_code) AS parameter_code,
       coalesce(o.observed_at, n.observed_at) AS observed_at,
       CASE WHEN n.entity_id IS NULL THEN 'untouched' WHEN o.entity_id IS NULL THEN 'new'
            WHEN o.value IS NOT DISTINCT FROM n.value
             AND o.approval_status IS NOT DISTINCT FROM n.approval_status
             AND o.qualifier IS NOT DISTINCT FROM n.qualifier THEN 'unchanged'
            ELSE 'updated' END AS action,
       CASE WHEN action IN ('new', 'updated') THEN n.value ELSE o.value END AS value,
       CASE WHEN action IN ('new', 'updated') THEN n.approval_status
            ELSE o.approval_status END AS approval_status,
       CASE WHEN action IN ('new', 'updated') THEN n.qualifier ELSE o.qualifier END AS qualifier,
       CASE WHEN action IN ('new', 'updated') THEN n.raw_payload
            ELSE o.raw_payload END AS raw_payload,
       CASE WHEN action IN ('new', 'updated') THEN n.collected_at
            ELSE o.collected_at END AS collected_at,
       coalesce(action = 'updated' AND o.approval_status <> 'Approved'
                AND n.approval_status = 'Approved', false) AS newly_approved
FROM old_rows o FULL OUTER JOIN new_rows n
  ON o.entity_id = n.entity_id AND o.parameter_code = n.parameter_code
 AND o.observed_at = n.observed_at
"""

# -- derived layers ----------------------------------------------------------

BLOCKS["baselines"] = """
SELECT g.entity_id, g.metric, g.day_of_year, s.mu,
       CASE WHEN s.sigma = 0 THEN NULL ELSE s.sigma END AS sigma, s.n_years
FROM (SELECT DISTINCT r.entity_id, r.metric, d.day_of_year
      FROM raw r CROSS JOIN (SELECT unnest(range(1, 367)) AS day_of_year) d
      WHERE r.observed_at BETWEEN DATE '1995-01-01' AND DATE '1999-12-31') g
LEFT JOIN (
  SELECT entity_id, metric,
         ((dayofyear(observed_at) - 1 + k) % 366 + 366) % 366 + 1 AS day_of_year,
         avg(value) AS mu, stddev_samp(value) AS sigma,
         count(DISTINCT year(observed_at)) AS n_years
  FROM raw CROSS JOIN (SELECT unnest(range(-7, 8)) AS k)
  WHERE observed_at BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'
  GROUP BY 1, 2, 3) s USING (entity_id, metric, day_of_year)
"""
BLOCKS["stats"] = """
SELECT entity_id, metric, observed_at, count(*) AS observation_count, min(value) AS minimum,
       max(value) AS maximum, avg(value) AS average
FROM raw WHERE value IS NOT NULL GROUP BY 1, 2, 3
"""
BLOCKS["ranked_stats"] = """
SELECT *, cume_dist() OVER (PARTITION BY entity_id, metric ORDER BY average) * 100.0
          AS flow_percentile
FROM stats
"""
BLOCKS["dense"] = """
SELECT c.entity_id, c.metric, c.observed_at, coalesce(r.observation_count, 0) AS observation_count,
       r.minimum, r.maximum, r.average, r.flow_percentile
FROM (SELECT entity_id, metric,
             CAST(unnest(generate_series(min(observed_at),
                  (SELECT max(observed_at) FROM stats), INTERVAL 1 DAY)) AS DATE) AS observed_at
      FROM stats GROUP BY 1, 2) c
LEFT JOIN ranked_stats r USING (entity_id, metric, observed_at)
"""
BLOCKS["daily"] = """
SELECT f.entity_id, f.metric, f.observed_at, f.observation_count, f.minimum, f.maximum, f.average,
       f.average - lag(f.average, 1) OVER w AS daily_change,
       (f.average - lag(f.average, 3) OVER w) / 3.0 AS rise_rate_3d,
       f.flow_percentile,
       CASE WHEN b.sigma IS NOT NULL THEN (f.average - b.mu) / b.sigma END AS anomaly_score,
       CASE WHEN f.observation_count > 0 THEN 1.0 ELSE 0.0 END AS completeness_score,
       f.average / nullif(max(f.average) OVER (PARTITION BY f.entity_id, f.metric), 0)
         AS record_proximity,
       year(f.observed_at) AS year
FROM dense f LEFT JOIN baselines b
  ON f.entity_id = b.entity_id AND f.metric = b.metric
 AND dayofyear(f.observed_at) = b.day_of_year
WINDOW w AS (PARTITION BY f.entity_id, f.metric ORDER BY f.observed_at)
"""
BLOCKS["category"] = f"""
SELECT observed_at AS date, region, metric, count(*) AS entity_count,
       count(*) FILTER (WHERE abs(anomaly_score) >= {CFG.extreme_z}) AS event_count,
       avg(anomaly_score) AS average_anomaly,
       count(*) FILTER (WHERE abs(anomaly_score) >= {CFG.extreme_z}) AS extreme_entity_count,
       year(observed_at) AS year
FROM daily LEFT JOIN stations USING (entity_id) GROUP BY observed_at, region, metric
"""
BLOCKS["risers"] = """
SELECT observed_at AS date, region, metric, entity_id, station_name, rise_rate_3d,
       average AS value,
       row_number() OVER (PARTITION BY observed_at, region, metric
                          ORDER BY rise_rate_3d DESC, entity_id) AS rank
FROM daily JOIN stations USING (entity_id)
WHERE completeness_score > 0 AND rise_rate_3d IS NOT NULL
QUALIFY rank <= 5
"""
BLOCKS["placed"] = """
SELECT d.*, s.station_name, s.region, s.state, s.latitude, s.longitude
FROM daily d JOIN stations s USING (entity_id)
"""
BLOCKS["flow"] = """
SELECT entity_id, strftime(observed_at, '%Y-%m') AS period, avg(average) AS mean_flow_cfs,
       count(*) AS n_days
FROM daily WHERE metric = 'price' GROUP BY 1, 2
"""
BLOCKS["generation_base"] = """
SELECT l.entity_id, m.period, m.generation_thousand_mwh
FROM monthly m JOIN locations l ON m.location = l.eia_location
WHERE m.generation_thousand_mwh IS NOT NULL
"""
BLOCKS["extension"] = """
SELECT strftime(day, '%Y-%m') AS period, sum(mw) * 24.0 / 1000.0 AS generation_thousand_mwh
FROM (SELECT CAST(ts AS DATE) AS day, avg(value) AS mw FROM hourly GROUP BY 1)
WHERE mw IS NOT NULL GROUP BY 1 HAVING count(*) >= 25
"""
BLOCKS["generation"] = """
SELECT * FROM generation_base
UNION ALL
SELECT l.entity_id, x.period, x.generation_thousand_mwh
FROM locations l CROSS JOIN extension x
WHERE l.eia_location IN ('L-0', 'L-1', 'L-2')
  AND x.period > (SELECT max(period) FROM generation_base)
  AND (l.entity_id, x.period) NOT IN (SELECT (entity_id, period) FROM generation_base)
"""
BLOCKS["pairs"] = """
SELECT f.entity_id, f.period, f.mean_flow_cfs, g.generation_thousand_mwh, l.confidence
FROM flow f JOIN generation g USING (entity_id, period) JOIN locations l USING (entity_id)
"""
BLOCKS["climatology"] = """
SELECT entity_id, month(DATE '2001-01-01' + CAST(day_of_year - 1 AS INTEGER)) AS month,
       avg(mu) AS mu_month, avg(sigma) AS sigma_month
FROM baselines WHERE metric = 'price' GROUP BY 1, 2
"""
BLOCKS["anomalies"] = """
SELECT p.*, CASE WHEN c.sigma_month > 1e-9
                 THEN (p.mean_flow_cfs - c.mu_month) / c.sigma_month END AS anomaly_flow,
       CASE WHEN stddev_samp(p.generation_thousand_mwh) OVER w > 1e-9
            THEN (p.generation_thousand_mwh - avg(p.generation_thousand_mwh) OVER w)
                 / stddev_samp(p.generation_thousand_mwh) OVER w END AS anomaly_gen
FROM pairs p LEFT JOIN climatology c
  ON p.entity_id = c.entity_id AND CAST(substr(p.period, 6, 2) AS INTEGER) = c.month
WINDOW w AS (PARTITION BY p.entity_id)
"""


def correlations_sql(source: str, keys: str, x: str, y: str) -> str:
    """Pearson and Spearman per group over complete pairs."""
    def rank(c: str) -> str:
        return (f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) "
                f"+ (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0")

    def guarded(a: str, b: str) -> str:
        return (f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 "
                f"THEN corr({a}, {b}) END")

    return f"""
SELECT {keys}, count(*) AS n, {guarded('x', 'y')} AS pearson, {guarded('rx', 'ry')} AS spearman
FROM (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry
      FROM (SELECT {keys}, {x} AS x, {y} AS y FROM {source}
            WHERE {x} IS NOT NULL AND {y} IS NOT NULL))
GROUP BY {keys}
"""


def p_value_sql(r: str, df: str, steps: int = 2000) -> str:
    """Two-sided p of a correlation by Simpson's rule on the density in polar form."""
    a = f"asin(abs({r}))"
    h = f"((pi() / 2 - {a}) / {steps})"
    term = (f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(greatest(cos({a} + i * {h}), 0), {df} - 1)")
    total = f"list_sum([{term} FOR i IN range(0, {steps + 1})])"
    scale = f"2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return f"CASE WHEN {r} IS NOT NULL THEN {scale} * {h} / 3 * {total} END"


BLOCKS["corr_flow_raw"] = correlations_sql(
    "pairs", "entity_id", "mean_flow_cfs", "generation_thousand_mwh")
BLOCKS["corr_flow_anom"] = correlations_sql(
    "anomalies", "entity_id", "anomaly_flow", "anomaly_gen")
BLOCKS["lagged"] = " UNION ALL ".join(
    f"""SELECT entity_id, period, {k} AS lag, anomaly_flow,
       lead(anomaly_gen, {k}) OVER (PARTITION BY entity_id ORDER BY period) AS anomaly_gen
FROM anomalies WHERE anomaly_flow IS NOT NULL AND anomaly_gen IS NOT NULL""" for k in (0, 1, 2))
BLOCKS["corr_lagged"] = correlations_sql("lagged", "entity_id, lag", "anomaly_flow", "anomaly_gen")
BLOCKS["best_lags"] = """
SELECT entity_id, lag AS best_lag, coalesce(spearman, 0) AS best_lag_corr FROM corr_lagged
WHERE n >= 5
QUALIFY row_number() OVER (PARTITION BY entity_id
                           ORDER BY coalesce(abs(spearman), 0) DESC, lag) = 1
"""
BLOCKS["correlation_raw"] = f"""
SELECT e.entity_id, coalesce(l.eia_location, '') AS eia_location,
       coalesce(l.confidence, 'low') AS confidence, coalesce(r.n, 0) AS n_months,
       r.pearson AS pearson_raw, {p_value_sql('r.pearson', '(r.n - 2)')} AS pearson_raw_p,
       r.spearman AS spearman_raw, {p_value_sql('r.spearman', '(r.n - 2)')} AS spearman_raw_p,
       a.pearson AS pearson_anom, {p_value_sql('a.pearson', '(a.n - 2)')} AS pearson_anom_p,
       a.spearman AS spearman_anom, {p_value_sql('a.spearman', '(a.n - 2)')} AS spearman_anom_p,
       b.best_lag, b.best_lag_corr
FROM (SELECT DISTINCT entity_id FROM pairs) e
LEFT JOIN (SELECT * FROM corr_flow_raw WHERE n >= 5) r USING (entity_id)
LEFT JOIN (SELECT * FROM corr_flow_anom WHERE n >= 5) a USING (entity_id)
LEFT JOIN best_lags b USING (entity_id)
LEFT JOIN locations l USING (entity_id)
"""
BLOCKS["correlation_final"] = """
SELECT *, CASE WHEN NOT significant THEN 'not_significant'
               WHEN abs(spearman_anom) >= 0.5 THEN 'tight'
               WHEN abs(spearman_anom) >= 0.3 THEN 'moderate' ELSE 'weak' END AS tier,
       coalesce(abs(spearman_anom) < 0.2, false) AS decoupled
FROM (SELECT *, coalesce(pearson_anom_p < 0.05 AND spearman_anom_p < 0.05, false) AS significant
      FROM correlation_raw)
"""
BLOCKS["flashiness"] = """
SELECT entity_id, metric, year, region,
       sum(abs(daily_change)) / nullif(sum(average), 0) AS flashiness_index, count(*) AS n_days
FROM placed
WHERE completeness_score > 0 AND daily_change IS NOT NULL AND average > 0
GROUP BY 1, 2, 3, 4
"""
BLOCKS["ranked_flashiness"] = """
SELECT *, rank() OVER (PARTITION BY region, metric, year ORDER BY flashiness_index DESC)
          AS region_rank,
       count(*) OVER (PARTITION BY region, metric, year) AS n_gauges,
       CASE WHEN flashiness_index < 0.1 THEN 'Low' WHEN flashiness_index < 0.3 THEN 'Moderate'
            WHEN flashiness_index < 0.6 THEN 'High' ELSE 'Very High' END AS flashiness_class
FROM flashiness
"""
BLOCKS["location_totals"] = """
SELECT l.eia_location, p.period, sum(p.generation_thousand_mwh) AS generation_thousand_mwh,
       max(p.generation_thousand_mwh) AS generation_once
FROM pairs p JOIN locations l USING (entity_id) GROUP BY 1, 2
"""


def whole_z_sql(x: str, keys: str) -> str:
    spread = f"stddev_samp({x}) OVER (PARTITION BY {keys})"
    return (f"CASE WHEN {spread} > 0 THEN ({x} - avg({x}) OVER (PARTITION BY {keys})) / {spread} "
            f"ELSE {x} * 0.0 END")


BLOCKS["location_scores"] = f"""
SELECT eia_location, period, {whole_z_sql('generation_thousand_mwh', 'eia_location')} AS gen_z
FROM location_totals
"""
_month = "PARTITION BY entity_id, substr(period, 6, 2)"
BLOCKS["flow_scores"] = f"""
SELECT entity_id, period,
       CASE WHEN stddev_pop(mean_flow_cfs) OVER ({_month}) > 0
            THEN (mean_flow_cfs - avg(mean_flow_cfs) OVER ({_month}))
                 / stddev_pop(mean_flow_cfs) OVER ({_month}) ELSE 0.0 END AS flow_z
FROM pairs
"""
BLOCKS["tight"] = "SELECT * FROM correlation_final WHERE tier = 'tight'"
BLOCKS["overlay"] = """
SELECT f.entity_id, f.period, f.flow_z, g.gen_z,
       coalesce((f.flow_z > 0 AND g.gen_z > 0) OR (f.flow_z < 0 AND g.gen_z < 0), false)
         AS together
FROM flow_scores f LEFT JOIN tight t USING (entity_id)
LEFT JOIN location_scores g ON t.eia_location = g.eia_location AND f.period = g.period
"""
BLOCKS["next_month"] = """
SELECT f.entity_id, f.period, f.flow_z, g.gen_z AS gen_next_z
FROM flow_scores f JOIN tight t USING (entity_id)
JOIN location_scores g ON t.eia_location = g.eia_location
 AND strftime(CAST(f.period || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') = g.period
WHERE f.flow_z IS NOT NULL AND g.gen_z IS NOT NULL
"""


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


BLOCKS["state_regions"] = (
    "SELECT * FROM (VALUES "
    + _values([(name, code, region) for name, code, region in STATES if region])
    + ") AS v(name, code, region)"
)
BLOCKS["customer_regions"] = """
SELECT 'C-' || c_custkey AS entity_id, c_name AS station_name,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Oregon' ELSE '' END AS state,
       lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS state_code,
       coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'Curated' END, n.region, k.region,
                'Unknown') AS region,
       CAST(c_nationkey AS DOUBLE) AS longitude,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS hydrologic_unit_code,
       c_acctbal AS drainage_area
FROM customer
LEFT JOIN state_regions n
  ON n.name = upper(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Oregon' END)
LEFT JOIN state_regions k ON k.code = lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0')
"""
BLOCKS["record_starts"] = """
SELECT 'C-' || o_custkey AS entity_id,
       CAST(substr(arg_max(b, e || b), 1, 4) AS INTEGER) AS first_year_of_record
FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS b,
             strftime(CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice / 1000) AS INTEGER),
                      '%Y-%m-%d') AS e FROM orders)
GROUP BY 1
"""


# -- composition -------------------------------------------------------------

def _mentioned(sql: str) -> set[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", sql))
    return words & set(BLOCKS)


def compose(sql: str) -> str:
    """The statement with every block it needs, directly or not, as a CTE."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in sorted(_mentioned(BLOCKS[name])):
            need(other)
        ordered.append(name)

    for name in sorted(_mentioned(sql)):
        need(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({BLOCKS[name].strip()})" for name in ordered)
    return f"WITH {ctes}\n{sql}"
