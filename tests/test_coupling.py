import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import Settings
from tidemark.functions import classify
from tidemark.operators import coupling
from tidemark.plans import coupling as plans

CFG = Settings()
LOCATIONS = "entity_id string, eia_location string, eia_location_name string, confidence string"
PAIRS = ("entity_id string, period string, mean_flow_cfs double, "
         "generation_thousand_mwh double, confidence string")


def months(n, start=(2010, 1)):
    out = []
    y, m = start
    for _ in range(n):
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


@pytest.fixture
def locations(spark):
    return spark.createDataFrame(
        [("a", "L1", "One", "high"), ("b", "L1", "One", "low"), ("c", "L2", "Two", "high")],
        LOCATIONS)


def ranks(xs):
    return [1 + sum(y < x for y in xs) + (sum(y == x for y in xs) - 1) / 2 for x in xs]


def corr(xs, ys):
    n = len(xs)
    mx, my = sum(xs) / n, sum(ys) / n
    sx = math.sqrt(sum((x - mx) ** 2 for x in xs))
    sy = math.sqrt(sum((y - my) ** 2 for y in ys))
    return sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / (sx * sy) if sx and sy else None


def test_flow_monthly_counts_gap_days(spark):
    daily = spark.createDataFrame(
        [("a", "streamflow", date(2020, 1, d), v) for d, v in ((1, 2.0), (2, None), (3, 4.0))]
        + [("a", "stage", date(2020, 1, 1), 99.0), ("z", "streamflow", date(2020, 1, 1), 1.0)],
        "entity_id string, metric string, observed_at date, average double")
    only = spark.createDataFrame([("a",)], "entity_id string")
    row, = coupling.flow_monthly(daily, CFG, only).collect()
    assert (row.period, row.mean_flow_cfs, row.n_days) == ("2020-01", 3.0, 3)


def test_generation_base_repeats_location_values(spark, locations):
    monthly = spark.createDataFrame(
        [("L1", "2020-01", 5.0), ("L1", "2020-02", None), ("L9", "2020-01", 1.0)],
        "location string, period string, generation_thousand_mwh double")
    got = coupling.generation_base(monthly, locations).collect()
    assert sorted((r.entity_id, r.period, r.generation_thousand_mwh) for r in got) == [
        ("a", "2020-01", 5.0), ("b", "2020-01", 5.0)]


def test_hourly_series_needs_25_days(spark):
    rows = []
    for month, n in ((1, 25), (2, 24)):
        for d in range(1, n + 1):
            rows += [(datetime(2020, month, d, h), float(h)) for h in (0, 12)]
    rows.append((datetime(2020, 2, 25), None))
    hourly = spark.createDataFrame(rows, "ts timestamp, value double")
    got = coupling.daily_to_monthly(coupling.hourly_to_daily(hourly), CFG).collect()
    assert [(r.period, r.generation_thousand_mwh) for r in got] == [("2020-01", 25 * 6 * 24 / 1000)]


def test_extension_starts_after_the_global_last_month(spark, locations):
    columns = "entity_id string, period string, generation_thousand_mwh double"
    base = spark.createDataFrame([("a", "2020-01", 1.0), ("c", "2020-03", 2.0)], columns)
    extra = spark.createDataFrame(
        [(p, 9.0) for p in ("2020-02", "2020-03", "2020-04")],
        "period string, generation_thousand_mwh double")
    targets = coupling.entities_at(locations, ["L1"])
    got = coupling.extend_generation(base, extra, targets).collect()
    assert sorted((r.entity_id, r.period) for r in got) == [
        ("a", "2020-01"), ("a", "2020-04"), ("b", "2020-04"), ("c", "2020-03")]
    none = extra.filter("period < '2000'")
    assert coupling.extend_generation(base, none, targets).count() == 2


def test_alignment_refuses_unknown_entities(spark, locations):
    flow = spark.createDataFrame([("a", "2020-01", 1.0), ("q", "2020-01", 1.0)],
                                 "entity_id string, period string, mean_flow_cfs double")
    gen = spark.createDataFrame([("a", "2020-01", 1.0), ("q", "2020-01", 1.0)],
                                "entity_id string, period string, generation_thousand_mwh double")
    assert coupling.aligned_pairs(flow.filter("entity_id = 'a'"), gen, locations).count() == 1
    with pytest.raises(Exception, match="no location row for q"):
        coupling.aligned_pairs(flow, gen, locations).collect()


@pytest.fixture
def case(spark, locations):
    """Three entities: lagged by one row with missing months, too short, constant."""
    rng = random.Random(11)
    pairs, periods = [], [p for i, p in enumerate(months(40)) if i % 9 != 4]
    flow = [rng.gauss(100, 10) for _ in periods]
    for i, p in enumerate(periods):
        gen = flow[i - 1] * 2 + rng.gauss(0, 4) if i else 200.0
        pairs.append(("a", p, round(flow[i], 0), gen, "high"))
    pairs += [("b", p, 1.0 * i, 2.0 * i, "low") for i, p in enumerate(months(4))]
    pairs += [("c", p, rng.gauss(5, 1), 7.0, "high") for p in months(12)]
    baselines = spark.createDataFrame(
        [(e, "streamflow", d, 100.0 + d / 10, 10.0, 20) for e in "abc" for d in range(1, 367)],
        "entity_id string, metric string, day_of_year int, mu double, sigma double, n_years int")
    return pairs, spark.createDataFrame(pairs, PAIRS), baselines


def test_correlation_tables(case, locations):
    rows, pairs, baselines = case
    raw = coupling.correlation_raw(pairs, baselines, locations, CFG)
    got = {r.entity_id: r for r in raw.collect()}
    a = [r for r in rows if r[0] == "a"]
    xs, ys = [r[2] for r in a], [r[3] for r in a]
    assert got["a"].n_months == len(a)
    assert got["a"].pearson_raw == pytest.approx(corr(xs, ys))
    assert got["a"].spearman_raw == pytest.approx(corr(ranks(xs), ranks(ys)))
    assert got["a"].best_lag == 1
    # fewer than five months: only the count is known
    assert got["b"].n_months == 4
    assert {got["b"][c] for c in ("pearson_raw", "spearman_raw_p", "spearman_anom", "best_lag",
                                  "best_lag_corr")} == {None}
    # constant generation: no correlation, the lag scan keeps its starting point
    assert got["c"].pearson_raw is None and got["c"].best_lag is None and got["c"].n_months == 12
    final = {r.entity_id: r for r in coupling.correlation_final(raw).collect()}
    assert final["b"].tier == final["c"].tier == "not_significant"
    assert not final["b"].decoupled and not final["b"].significant


def test_climatology_puts_day_366_into_january(spark):
    base = spark.createDataFrame(
        [("a", "streamflow", d, float(v), 1.0) for d, v in ((1, 0), (31, 3), (32, 5), (366, 9))],
        "entity_id string, metric string, day_of_year int, mu double, sigma double")
    got = {r.month: r.mu_month for r in coupling.monthly_climatology(base, "streamflow").collect()}
    assert got == {1: 4.0, 2: 5.0}


def test_lags_shift_rows_and_smallest_lag_wins_draws(spark):
    series = spark.createDataFrame(
        [("a", p, float(i % 2), float(i % 2), 1.0, 1.0) for i, p in enumerate(months(12))]
        + [("a", "2012-01", None, 1.0, 1.0, None), ("short", "2012-01", 1.0, 1.0, 1.0, 1.0)],
        "entity_id string, period string, anomaly_flow double, anomaly_gen double, "
        "mean_flow_cfs double, generation_thousand_mwh double")
    scan = coupling.correlation_scan(series, CFG)
    sizes = {r.pairing: r.n for r in scan.filter("entity_id = 'a'").collect()}
    assert sizes == {-1: 12, 0: 12, 1: 11, 2: 10}
    best = {r.entity_id: r.b for r in scan.groupBy("entity_id").agg(
        coupling.best_lag(CFG).alias("b")).collect()}       # rho is 1, -1, 1
    assert (best["a"].lag, best["a"].spearman) == (0, pytest.approx(1.0))
    assert best["short"] is None


def test_scores_of_flat_series_are_zero(spark):
    df = spark.createDataFrame(
        [("a", p, v, int(p[5:])) for p, v in (("2020-01", 3.0), ("2021-01", 3.0),
                                              ("2020-02", 1.0), ("2021-02", 3.0),
                                              ("2020-03", None))],
        "entity_id string, period string, x double, month int")
    got = {r.period: r for r in df.select(
        "period", coupling.calendar_month_anomaly("x", ["entity_id"]).alias("m"),
        coupling.whole_series_z("x", ["entity_id"]).alias("w")).collect()}
    assert [got[p].m for p in ("2020-01", "2021-01", "2020-02", "2021-02", "2020-03")] == [
        0.0, 0.0, -1.0, 1.0, 0.0]
    assert got["2020-01"].w == pytest.approx(0.5) and got["2020-03"].w is None
    flat = df.filter("month = 1").select(coupling.whole_series_z("x", ["entity_id"]).alias("w"))
    assert [r.w for r in flat.collect()] == [0.0, 0.0]


def test_spans(spark):
    flags = [True, True, False, True, False, False, True]
    df = spark.createDataFrame(
        [("a", p, f) for p, f in zip(months(7), flags)] + [("b", "2010-01", True)],
        "entity_id string, period string, together boolean")
    got = plans.comovement_spans(df).orderBy("entity_id", "span_start").collect()
    assert [(r.entity_id, r.span_start, r.span_end, r.n_rows) for r in got] == [
        ("a", "2010-01", "2010-02", 2), ("a", "2010-04", "2010-04", 1),
        ("a", "2010-07", "2010-07", 1), ("b", "2010-01", "2010-01", 1)]
    assert (got[0].x0, got[0].x1) == (date(2009, 12, 31), date(2010, 2, 2))


def test_overlay_sums_location_per_gauge_and_skips_other_tiers(spark, locations):
    rng = random.Random(2)
    rows = [(e, p, rng.random(), float(i), "high")
            for e in "ab" for i, p in enumerate(months(24))]
    pairs = spark.createDataFrame(rows, PAIRS)
    final = spark.createDataFrame([("a", "L1", "tight"), ("b", "L1", "weak")],
                                  "entity_id string, eia_location string, tier string")
    totals = plans.location_totals(pairs, locations).filter("period = '2010-03'").first()
    assert (totals.generation_thousand_mwh, totals.generation_once) == (4.0, 2.0)
    got = plans.overlay(pairs, final, locations).collect()
    assert all((r.gen_z is None) == (r.entity_id == "b") for r in got)
    assert not any(r.together for r in got if r.entity_id == "b")
    scatter = plans.next_month_pairs(pairs, final, locations, "a")
    by_period = {r.period: r.gen_z for r in got if r.entity_id == "a"}
    for r in scatter.collect():
        assert r.gen_next_z == pytest.approx(by_period[months(2, (int(r.period[:4]), int(r.period[5:])))[1]])
    assert scatter.count() == 23
    fit, = plans.next_month_fit(scatter).collect()
    assert fit.n == 23 and fit.slope is not None and fit.rho_lag is not None


def test_tier_rules(spark):
    df = spark.createDataFrame(
        [(0.5, True), (-0.5, True), (0.3, True), (0.29, True), (0.9, False), (None, False)],
        "rho double, sig boolean")
    got = df.select(classify.coupling_tier(F.col("rho"), F.col("sig")).alias("t"),
                    classify.decoupled(F.col("rho")).alias("d")).collect()
    assert [r.t for r in got] == ["tight", "tight", "moderate", "weak", "not_significant",
                                  "not_significant"]
    assert not any(r.d for r in got)


def test_tier_changes_and_order(spark, locations):
    def table(rows):
        return spark.createDataFrame(
            rows, "entity_id string, eia_location string, spearman_anom double, "
                  "pearson_anom double, best_lag int, tier string, n_months int")
    old = table([("a", "L1", 0.6, 0.5, 0, "tight", 9), ("b", "L1", 0.6, 0.5, 0, "tight", 9)])
    new = table([("b", "L1", -0.9, 0.5, 0, "tight", 9), ("c", "L2", 0.7, 0.5, 0, "tight", 9)])
    changes = {(r.entity_id, r.change) for r in plans.tier_changes(old, new).collect()}
    assert changes == {("a", "lost"), ("c", "gained")}
    geo = spark.createDataFrame([("c", "Sea", "S", "R", 1.0, 2.0)],
                                "entity_id string, station_name string, state string, "
                                "region string, latitude double, longitude double")
    ranked = plans.tight_gauges(new, geo, locations).collect()
    assert [(r.entity_id, r.station_name) for r in ranked] == [("b", None), ("c", "Sea")]
    assert plans.all_gauges(new, geo).count() == 2


def test_salts_follow_the_size_of_a_location(spark):
    from pyspark.sql import functions as F

    rows = [(f"e{k}", "hot" if k < 900 else f"l{k % 20}" if k < 990 else None) for k in range(1000)]
    locations = spark.createDataFrame(rows, "entity_id string, eia_location string")
    monthly = spark.createDataFrame([(where, f"2020-{m:02d}", float(m)) for where in ["hot", *[f"l{k}" for k in range(20)], "none", None]
                                     for m in range(1, 13)], "location string, period string, v double")
    salts = {r[0]: r[1] for r in coupling.location_salts(locations, 64).collect()}
    assert salts.pop("hot") == 15 and set(salts.values()) == {1} and None not in salts
    got = coupling.for_each_entity(monthly, locations, 64)
    assert got.columns == ["entity_id", "period", "v"] and got.count() == 990 * 12 == got.distinct().count()
    # no salt of the hot location holds more than twice the usual number of its entities
    spread = locations.filter("eia_location = 'hot'").groupBy(F.pmod(F.xxhash64("entity_id"), F.lit(15))).count()
    sizes = sorted(r[1] for r in spread.collect())
    assert len(sizes) == 15 and sizes[-1] <= 2 * sizes[7]
