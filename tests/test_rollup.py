from datetime import date

import pytest

from tidemark import Settings
from tidemark.operators.rollup import category_metrics
from tidemark.plans import dashboard

DAY = date(2020, 5, 1)
SCHEMA = ("entity_id string, metric string, observed_at date, average double, "
          "rise_rate_3d double, anomaly_score double, completeness_score double, year int")


@pytest.fixture
def rolled(spark, stations):
    rows = [(f"r{i}", "m", DAY, float(i), rise, None, 1.0, 2020)
            for i, rise in enumerate([1.0, 2.0, 2.0, 9.0, 5.0, 2.0, -1.0])]
    rows += [
        ("q1", "m", DAY, 1.0, None, -2.5, 1.0, 2020),
        ("q2", "m", DAY, None, None, None, 0.0, 2020),
        ("q3", "m", DAY, 3.0, None, 2.4, 1.0, 2020),
        ("lost", "m", DAY, 3.0, 4.0, 3.0, 1.0, 2020),
    ]
    places = [(f"r{i}", f"Station {i}", "X", "risers", 0.0, 0.0) for i in range(7)]
    places += [(q, q, "Y", "quiet", 0.0, 0.0) for q in ("q1", "q2", "q3")]
    daily = spark.createDataFrame(rows, SCHEMA)
    out = category_metrics(daily, stations(places))
    return out, {r.region: r for r in out.collect()}


def test_counts(rolled):
    rows = rolled[1]
    risers, quiet, lost = rows["risers"], rows["quiet"], rows[None]
    # every row counts, gap rows too; a group without any score has zero events
    assert (risers.entity_count, risers.event_count, risers.average_anomaly) == (7, 0, None)
    assert (quiet.entity_count, quiet.event_count) == (3, 1)
    assert quiet.average_anomaly == pytest.approx(-0.05)
    assert quiet.extreme_entity_count == 1
    assert (lost.entity_count, lost.event_count) == (1, 1)


def test_top_risers_are_ordered_with_ties_by_id(rolled):
    rows = rolled[1]
    assert [r.entity_id for r in rows["risers"].fastest_risers] == ["r3", "r4", "r1", "r2", "r5"]
    assert rows["risers"].fastest_risers[0].asDict() == {
        "entity_id": "r3", "station_name": "Station 3", "rise_rate_3d": 9.0, "value": 3.0}
    assert rows["quiet"].fastest_risers is None
    assert rows[None].fastest_risers is None       # null region never joins its risers


def test_riser_rows_and_region_table(rolled):
    out = rolled[0]
    flat = dashboard.risers(out, "m", DAY, "risers").orderBy("rank").collect()
    assert [(r.rank, r.entity_id) for r in flat] == [
        (1, "r3"), (2, "r4"), (3, "r1"), (4, "r2"), (5, "r5")]
    assert dashboard.risers(out, "m", DAY, "quiet").count() == 0
    table = dashboard.region_table(out, "m", DAY).collect()
    assert [r.region for r in table] == [None, "quiet", "risers"]   # null score last
    assert table[1].fastest_risers == []
    assert dashboard.region_table(out, "m", DAY, "quiet").count() == 1


def test_cap(spark, stations):
    daily = spark.createDataFrame([
        ("a", "m", DAY, 1.0, None, None, 1.0, 2020),
        ("a", "m", date(2020, 5, 2), 1.0, None, None, 1.0, 2020)], SCHEMA)
    out = category_metrics(daily, stations([("a", "A", "S", "R", 0.0, 0.0)]), Settings(), DAY)
    assert [r.date for r in out.collect()] == [DAY]
