from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators.baseline import seasonal_baselines
from tidemark.operators.daily import daily_entity_metrics, daily_stats


def build(raw, today=None):
    daily = daily_entity_metrics(daily_stats(raw), seasonal_baselines(raw), today)
    return {(r.entity_id, r.metric, r.observed_at.isoformat()): r for r in daily.collect()}


ROWS = [
    ("a", "m", "2004-02-26", 1.0), ("a", "m", "2004-02-26", 3.0),
    ("a", "m", "2004-02-27", 5.0),
    ("a", "m", "2004-02-28", None),              # null value: a gap
    ("a", "m", "2004-02-29", 8.0),               # exactly three days after the first
    ("a", "m", "2004-03-02", 4.0),
    ("b", "m", "2004-03-01", 7.0),               # series of length one
]


def test_gap_filling_and_changes(readings):
    got = build(readings(ROWS), date(2004, 3, 3))
    a = [got["a", "m", d] for d in ("2004-02-26", "2004-02-27", "2004-02-28", "2004-02-29",
                                    "2004-03-01", "2004-03-02", "2004-03-03")]
    assert len(got) == 7 + 3
    assert [r.observation_count for r in a] == [2, 1, 0, 1, 0, 1, 0]
    assert [r.average for r in a] == [2.0, 5.0, None, 8.0, None, 4.0, None]
    assert [r.completeness_score for r in a] == [1, 1, 0, 1, 0, 1, 0]
    assert [r.daily_change for r in a] == [None, 3.0, None, None, None, None, None]
    assert [r.rise_rate_3d for r in a] == [None, None, None, 2.0, None, None, None]
    assert [r.record_proximity for r in a] == [0.25, 0.625, None, 1.0, None, 0.5, None]
    assert (a[0].minimum, a[0].maximum) == (1.0, 3.0)
    assert {r.year for r in a} == {2004}
    assert [got["b", "m", d].average for d in ("2004-03-01", "2004-03-02", "2004-03-03")] == [
        7.0, None, None]


def test_percentile_counts_ties_upwards(readings):
    rows = [("a", "m", f"2004-01-0{i}", v) for i, v in enumerate([5.0, 5.0, 1.0, 9.0], 1)]
    got = build(readings(rows))
    assert [got["a", "m", f"2004-01-0{i}"].flow_percentile for i in range(1, 5)] == [
        75.0, 75.0, 25.0, 100.0]


def test_today_cuts_rows_after_percentiles_and_drops_later_series(readings):
    rows = [("a", "m", "2004-01-01", 2.0), ("a", "m", "2004-01-05", 4.0),
            ("b", "m", "2004-01-04", 1.0)]
    got = build(readings(rows), date(2004, 1, 3))
    assert sorted(k[2] for k in got) == ["2004-01-01", "2004-01-02", "2004-01-03"]
    first = got["a", "m", "2004-01-01"]
    assert first.flow_percentile == 50.0          # ranked against the later day as well
    assert first.record_proximity == 1.0          # but compared with the kept days only


def test_default_end_is_the_newest_day(readings):
    got = build(readings([("a", "m", "2004-01-01", 2.0), ("b", "m", "2004-01-03", 1.0)]))
    assert ("a", "m", "2004-01-03") in got and len(got) == 4


def test_scores_against_the_baseline(readings):
    rows = [("a", "m", f"{y}-06-01", float(y - 2000)) for y in range(2004, 2024)]
    rows += [("a", "m", "2024-06-01", 99.0)]
    got = build(readings(rows))
    last = got["a", "m", "2024-06-01"]           # leap year: day 153, within the window of 152
    mu, sigma = 13.5, 5.916079783099616
    assert last.anomaly_score == pytest.approx((99 - mu) / sigma)
    assert got["a", "m", "2023-12-31"].anomaly_score is None


def test_dense_and_bounded(spark, readings):
    rows = [(e, "m", f"2005-0{m}-{d:02d}", float(d * m))
            for e in "xyz" for m in (1, 3, 7) for d in range(1, 28, 2 + ord(e) % 3)]
    raw = readings(rows)
    daily = daily_entity_metrics(daily_stats(raw), seasonal_baselines(raw))
    for r in daily.groupBy("entity_id").agg(
            F.count("*").alias("n"), F.countDistinct("observed_at").alias("d"),
            F.datediff(F.max("observed_at"), F.min("observed_at")).alias("span"),
            F.max("flow_percentile").alias("top"), F.min("flow_percentile").alias("low"),
            F.max("record_proximity").alias("peak")).collect():
        assert r.n == r.d == r.span + 1
        assert r.top == 100 and r.low > 0 and r.peak == 1


def test_incomplete_baselines_are_refused(readings):
    raw = readings([("a", "m", "2004-01-01", 2.0)])
    short = seasonal_baselines(raw).filter("day_of_year <> 60")
    with pytest.raises(Exception, match="lack days-of-year"):
        daily_entity_metrics(daily_stats(raw), short).collect()
