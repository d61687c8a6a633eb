from datetime import date, timedelta

import pytest

from tidemark import Settings, schemas
from tidemark.plans import dashboard, quality, series

DAY = date(2020, 3, 1)


def daily_rows(spark, rows):
    """(entity, metric, day, average, rise, z, change) tuples as a daily layer."""
    out = []
    for e, m, d, average, rise, z, change in rows:
        seen = average is not None
        out.append((e, m, d, int(seen), average, average, average, change, rise,
                    50.0 if seen else None, z, float(seen), 0.5 if seen else None, d.year))
    return spark.createDataFrame(out, schemas.DAILY_ENTITY_METRICS)


@pytest.fixture
def places(stations):
    return stations([("a", "A", "S1", "R1", 1.0, 2.0), ("b", "B", "S1", "R1", 1.0, 2.0),
                     ("c", "C", "S1", "R2", 1.0, 2.0), ("d", "D", "S2", "R2", 1.0, 2.0)])


def test_kpi_cards(spark, places):
    daily = daily_rows(spark, [
        ("a", "m", DAY, 1.0, 3.0, -2.5, 1.0), ("b", "m", DAY, 2.0, 3.0, 0.5, 1.0),
        ("c", "m", DAY, 3.0, None, -1.0, 1.0), ("d", "m", DAY, None, None, None, None),
        ("d", "m", DAY - timedelta(days=1), 4.0, 9.0, 9.0, 1.0),
        ("x", "m", DAY, 1.0, 99.0, 99.0, 1.0)])              # not a known station
    r, = dashboard.kpi_cards(daily, places, "m", DAY).collect()
    assert (r.extreme_events_today, r.fastest_riser.entity_id) == (1, "a")
    assert r.most_below_normal == "R1"                       # both regions average −1: by name
    assert (r.gauges_reporting, r.total_gauges, r.total_rows) == (3, 4, 6)
    assert r.gap_rate == pytest.approx(1 / 6) and r.last_date == DAY
    empty, = dashboard.kpi_cards(daily, places, "m", date(2021, 1, 1)).collect()
    assert empty.extreme_events_today == 0
    assert {empty[c] for c in ("fastest_riser", "most_below_normal", "gauges_reporting",
                               "total_gauges", "total_rows")} == {None}


def test_default_date_skips_thin_days(spark, places):
    def day(offset, n):
        return [(e, "streamflow", DAY - timedelta(days=offset), 1.0 if i < n else None, None, None, None)
                for i, e in enumerate("abcd")]
    daily = daily_rows(spark, day(0, 1) + day(1, 2) + day(2, 4))
    assert dashboard.default_date(daily, places).first()[0] == DAY - timedelta(days=1)
    thin = daily_rows(spark, day(0, 1) + day(20, 4))
    assert dashboard.default_date(thin, places).first()[0] == DAY


def test_marker_sizes(spark):
    df = spark.createDataFrame(
        [("k", v) for v in (0.0, 4.0, 16.0, None, -1.0)] + [("one", 3.0)], "k string, v double")
    got = dashboard.marker_sizes(df, "v", ["k"]).collect()
    sizes = {(r.k, r.v): r.marker_size for r in got}
    assert sizes == {("k", 0.0): 5.0, ("k", 4.0): 12.5, ("k", 16.0): 20.0, ("k", None): 8.0,
                     ("k", -1.0): 8.0, ("one", 3.0): 8.0}
    assert dashboard.marker_sizes(df.filter("k = 'k'"), "v", []).filter("v = 4").first().marker_size == 12.5


def test_months_and_top_dates(spark):
    rows = [(date(2020, m, d), "R", metric, 1, n, 0.0, n, None, 2020)
            for m, d, metric, n in ((1, 1, "x", 4), (1, 1, "y", 3), (1, 2, "x", 1), (2, 1, "x", 7),
                                    (3, 1, "x", 0))]
    category = spark.createDataFrame(rows, schemas.DAILY_CATEGORY_METRICS)
    top = dashboard.top_anomaly_dates(category, 2).collect()
    assert [(r.date, r.total_events, r.metrics_breakdown) for r in top] == [
        (date(2020, 1, 1), 7, {"x": 4, "y": 3}), (date(2020, 2, 1), 7, {"x": 7})]
    months = dashboard.monthly_anomaly_counts(category).collect()
    assert [(r.month, r.total_events, r.is_high) for r in months] == [
        (1, 8, False), (2, 7, False), (3, 0, False)]
    assert months[0].threshold == pytest.approx(5 + 19 ** 0.5)


def test_region_states(spark, places):
    category = spark.createDataFrame(
        [(DAY, "R1", "m", 2, 1, -2.2, 1, None, 2020), (DAY, "R2", "m", 2, 1, None, 1, None, 2020)],
        schemas.DAILY_CATEGORY_METRICS)
    states = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "state string")
    got = {r.state: (r.region, r.n, r.events, r.code) for r in dashboard.region_states(
        category, places, states, "m", DAY).collect()}
    assert got == {"S1": ("R1", 2, 1, 0), "S2": ("R2", 0, 0, 6), "S3": (None, 0, 0, 7)}


def test_hydrograph(spark, places):
    cfg = Settings(overlay_metric="temp")
    d = [DAY + timedelta(days=i) for i in range(4)]
    daily = daily_rows(spark, [
        ("a", "flow", d[1], 5.0, 1.0, 3.0, 1.0), ("a", "flow", d[2], None, None, None, None),
        ("a", "temp", d[1], 20.0, None, None, None), ("a", "temp", d[3], 21.0, None, None, None)])
    rows = series.hydrograph(daily, places, "flow", d[0], d[3], "a", cfg).orderBy("observed_at").collect()
    assert [(r.average, r.water_temp, r.completeness_score) for r in rows] == [
        (None, None, 0.0), (5.0, 20.0, 1.0), (None, None, 0.0), (None, None, 0.0)]
    none = series.hydrograph(daily, places, "flow", d[0], d[3], "b", cfg).collect()
    assert len(none) == 4 and {r.completeness_score for r in none} == {0.0}
    base = spark.createDataFrame(
        [("a", "flow", DAY.timetuple().tm_yday + 1, 4.0, 0.5, 9)], schemas.SEASONAL_BASELINES)
    banded = {r.observed_at: r for r in series.banded_hydrograph(
        daily, base, places, "flow", d[0], d[3], "a", cfg).collect()}
    hit = banded[d[1]]
    assert (hit.lower_1s, hit.upper_2s, hit.is_event, hit.is_gap, hit.z_code) == (3.5, 5.0, True, False, 5)
    assert banded[d[0]].mu is None and banded[d[0]].is_gap and not banded[d[0]].is_event


def test_band_keeps_all_days_of_a_wrapping_span(spark):
    base = spark.createDataFrame(
        [("a", "m", d, 1.0, 1.0, 1) for d in range(1, 367)], schemas.SEASONAL_BASELINES)
    assert series.baseline_band(base, date(2020, 2, 1), date(2020, 2, 10), "a", "m").count() == 10
    assert series.baseline_band(base, date(2020, 12, 1), date(2021, 1, 10), "a", "m").count() == 366


def test_previous_year_folds_the_leap_day(spark):
    daily = daily_rows(spark, [("a", "m", date(2020, 2, d), float(d), None, None, None) for d in (28, 29)])
    got = series.previous_year(daily, "m", 2021, "a").collect()
    assert [r.observed_at for r in got] == [date(2021, 2, 28)] * 2


def test_flashiness_and_cards(spark, places):
    d = [DAY + timedelta(days=i) for i in range(3)]
    daily = daily_rows(spark, [
        ("a", "m", d[0], 10.0, None, None, None), ("a", "m", d[1], 20.0, None, None, 10.0),
        ("a", "m", d[2], 0.0, None, None, -20.0),            # not positive: left out
        ("b", "m", d[1], 10.0, None, None, -9.0), ("c", "m", d[1], 10.0, None, None, 9.9)])
    ranked = {r.entity_id: r for r in series.ranked_flashiness(daily, places, "m", 2020).collect()}
    assert (ranked["a"].flashiness_index, ranked["a"].n_days, ranked["a"].region_rank) == (0.5, 1, 2)
    assert (ranked["b"].region_rank, ranked["b"].n_gauges, ranked["c"].region_rank) == (1, 2, 1)
    one = series.flashiness_of(daily, places, "a", "m", 2020).first()
    assert (one.region_rank, one.n_gauges, one.flashiness_class) == (2, 2, "High")
    # no qualifying day: no rank, though the region has others
    gone = series.flashiness_of(daily, places, "d", "m", 2020).first()
    assert (gone.flashiness_index, gone.region_rank, gone.n_days, gone.n_gauges) == (None, None, 0, 1)
    card = series.personality_cards(daily, places, "a", "m", d[1]).first()
    assert (card.average, card.historical_max, card.flashiness_rank) == (20.0, 20.0, 2)
    assert card.proximity_class == "typical"
    every = {r.entity_id: r for r in series.all_personality_cards(daily, places, "m", d[1]).collect()}
    assert set(every) == {"a", "b", "c"} and every["a"].historical_max == 20.0


def test_window_stats_take_each_last_known_value(spark):
    daily = daily_rows(spark, [
        ("a", "m", DAY, 1.0, None, 2.0, None), ("a", "m", DAY + timedelta(days=1), 3.0, None, None, None),
        ("a", "m", DAY + timedelta(days=2), None, None, None, None),
        ("b", "m", DAY, None, None, None, None)])
    got = series.window_stats(daily, "m", DAY, DAY + timedelta(days=5)).collect()
    assert [(r.entity_id, r.average, r.anomaly_score, r.last_date) for r in got] == [
        ("a", 3.0, 2.0, DAY + timedelta(days=1))]


def test_health_report(spark, places):
    raw = spark.createDataFrame(
        [("a", "streamflow", DAY, 1.0), (None, "streamflow", DAY, None), ("b", "gage_height", None, 1.0)],
        "entity_id string, metric string, observed_at date, value double")
    empty = raw.limit(0)
    report = quality.health_report(raw, raw, empty, places, DAY + timedelta(days=4))
    got = {(r.check, r.subject): (r.observed, r.status) for r in report.collect()}
    lacking_metrics = set(Settings().expected_metrics) - {"streamflow", "gage_height"}
    assert got == {
        ("row_count", "raw_observations"): (3.0, "ok"),
        ("row_count", "daily_entity_metrics"): (3.0, "ok"),
        ("row_count", "daily_category_metrics"): (0.0, "fail"),
        ("identity_nulls", "entity_id"): (1.0, "fail"),
        ("identity_nulls", "observed_at"): (1.0, "fail"),
        ("identity_nulls", "metric"): (0.0, "ok"),
        ("value_null_share", "value"): (pytest.approx(1 / 3), "fail"),
        ("days_old", "observed_at"): (4.0, "warn"),
        ("missing_metric", "metric"): (1.0, "fail"),
        ("missing_entity_id", "entity_id"): (2.0, "warn"),
        **{("lacks_metric", m): (0.0, "fail") for m in lacking_metrics},
        ("lacks_entity_id", "c"): (0.0, "warn"), ("lacks_entity_id", "d"): (0.0, "warn"),
    }
    nothing = {(r.check, r.subject): r.status for r in quality.health_report(
        empty, empty, empty, places, DAY).collect()}
    assert nothing["row_count", "raw_observations"] == "fail"


def test_names_fall_back_to_ids(spark, places):
    ids = spark.createDataFrame([("a",), ("zz",)], "entity_id string")
    got = {r.entity_id: r.label for r in series.entity_names(ids, places).collect()}
    assert got == {"a": "A", "zz": "zz"}
