import json
from datetime import date, datetime

import pytest

from tidemark import schemas
from tidemark.functions.text import payload_field
from tidemark.sources import landed, layers, sinks

WHEN = datetime(2024, 5, 1, 12)


def feature(code="00060", value="1.5", day="2024-01-02", coords=(-100.5, 40.25), entity="E-1", **extra):
    return {"properties": {
        "monitoring_location_id": entity, "time": day, "parameter_code": code, "value": value,
        "unit_of_measure": "u", "approval_status": "Provisional", "qualifier": ["e"], **extra},
        "geometry": None if coords is None else {"coordinates": list(coords)}}


def test_observation_pages(spark, tmp_path):
    pages = [
        [feature(), feature("00065", "n/a"), feature("99999", None, coords=None)],
        [feature(value="2.5", statistic_id="00003"), feature(entity="E-2", coords=())],
    ]
    for i, features in enumerate(pages):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"features": features}, indent=1))
    rows = landed.observations(
        landed.read_pages(spark, str(tmp_path), schemas.OBSERVATION_PAGE), WHEN)
    assert rows.columns == schemas.columns(schemas.RAW_OBSERVATIONS)
    got = {(r.entity_id, r.parameter_code): r for r in rows.collect()}
    assert len(got) == 4                                    # the doubled key is kept once
    first = got["E-1", "00060"]
    assert (first.metric, first.value, first.observed_at) == ("streamflow", 2.5, date(2024, 1, 2))
    assert (first.latitude, first.longitude, first.qualifier) == (40.25, -100.5, ["e"])
    assert first.collected_at == WHEN and json.loads(first.raw_payload)["value"] == "2.5"
    assert json.loads(first.raw_payload)["statistic_id"] == "00003"      # nobody declared it
    assert (got["E-1", "00065"].metric, got["E-1", "00065"].value) == ("gage_height", None)
    odd = got["E-1", "99999"]
    assert (odd.metric, odd.value, odd.latitude) == ("99999", None, None)
    assert got["E-2", "00060"].latitude is None
    text = rows.select(payload_field(rows.raw_payload, "$.unit_of_measure").alias("u")).collect()
    assert {r.u for r in text} == {"u"}


def test_pages_as_text(spark):
    good = json.dumps({"features": [feature()]})
    df = spark.createDataFrame([(good,), (None,)], "page string")
    assert len(landed.parse_pages(df, "page", schemas.OBSERVATION_PAGE).collect()) == 1
    for bad in ("broken", good[:-20]):
        df = spark.createDataFrame([(good,), (bad,)], "page string")
        with pytest.raises(Exception, match="(?i)malformed"):
            landed.parse_pages(df, "page", schemas.OBSERVATION_PAGE).collect()


def test_cut_off_page_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"features": [feature()]})[:-20])
    with pytest.raises(Exception, match="(?i)malformed"):
        landed.read_pages(spark, str(tmp_path), schemas.OBSERVATION_PAGE).collect()


def test_stations(spark, tmp_path):
    def station(key, top=None, **props):
        return {"id": top, "properties": {"id": key, "monitoring_location_name": "N", **props},
                "geometry": {"coordinates": [-1.0, 2.0]}}
    page = {"features": [
        station("E-1", state_name="Oregon", state_code="41", hydrologic_unit_code="0102"),
        station(None, "E-2", state_name="Oregon"), station("E-3", state_code="06")]}
    (tmp_path / "s.json").write_text(json.dumps(page))
    periods = spark.createDataFrame(
        [("E-1", "1990-01-01", "2000-01-01"), ("E-1", "2003-01-01", "2024-01-01"),
         ("E-1", None, "2030-01-01"), ("E-2", "2010-01-01", None)], schemas.SERIES_PERIODS)
    curated = spark.createDataFrame([("E-2", "Home"), ("E-3", "")], "entity_id string, region string")
    rows = landed.stations(
        landed.read_pages(spark, str(tmp_path), schemas.STATION_PAGE), periods, curated)
    got = {r.entity_id: r for r in rows.collect()}
    assert [got[f"E-{i}"].region for i in (1, 2, 3)] == ["Pacific Northwest", "Home", "California"]
    assert [got[f"E-{i}"].first_year_of_record for i in (1, 2, 3)] == [2003, 2010, None]
    assert [got[f"E-{i}"].earliest_verified_year for i in (1, 2, 3)] == [2004, None, None]
    assert got["E-1"].hydrologic_unit_code == "0102" and got["E-3"].state == ""
    path = str(tmp_path / "csv")
    sinks.write_csv(rows, path)
    back = {r.entity_id: r for r in layers.read_dimension(spark, path, schemas.STATIONS).collect()}
    assert back["E-1"].hydrologic_unit_code == "0102"       # the leading zero survives
    assert back["E-2"].first_year_of_record == 2010


@pytest.mark.parametrize("time_column,value_column", [
    ("Interval Start", "NG: WAT"), ("Time", "Hydro"), ("stamp", "Hydro")])
def test_hourly_columns(spark, time_column, value_column):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5), 3)], [time_column, value_column])
    row, = landed.hourly_series(df).collect()
    assert (row.ts, row.value) == (datetime(2024, 1, 1, 5), 3.0)


def test_hourly_without_value_column(spark):
    with pytest.raises(ValueError):
        landed.hourly_series(spark.createDataFrame([(WHEN, 1)], ["Time", "Wind"]))


def test_export(spark, tmp_path):
    row = ("s", "a", date(2024, 1, 2), WHEN, "m", "c", 1.0, "u", None, None, "Approved",
           ["e", "r"], '{"k": "x, y"}')
    later = ("s", "a", date(2024, 1, 1), WHEN, "m", "c", 2.0, "u", None, None, "Approved", None, "{}")
    raw = spark.createDataFrame([row, later], schemas.RAW_OBSERVATIONS)
    got = sinks.export_history(raw, "a", "m").collect()
    assert [r.value for r in got] == [2.0, 1.0] and got[1].qualifier == "e;r"


def test_layer_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", "a", date(y, 1, 1), WHEN, m, "c", 1.0, "u", None, None, "A", None, "{}")
         for y in (2022, 2023) for m in ("x", "y")], schemas.RAW_OBSERVATIONS)
    path = str(tmp_path / "raw")
    sinks.write_raw(rows, path)
    layer = layers.read_layer(spark, path, schemas.RAW_OBSERVATIONS)
    one = layers.read_years(layer, date(2023, 5, 1), date(2023, 6, 1)).filter("metric = 'x'")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "DataFilters: []" in plan
    layers.register(tm_raw=layer)
    assert spark.sql("SELECT count(*) AS n FROM tm_raw").first().n == 4


def test_repeated_station_is_kept_once(spark):
    rows = spark.createDataFrame(
        [("E-1", {"id": None, "monitoring_location_name": n}, None) for n in ("x", "y")]
        + [(None, {"monitoring_location_name": "none"}, None)], schemas.STATION_FEATURE)
    got = landed.station_rows(rows).collect()
    assert [(r.entity_id, r.station_name) for r in got] == [("E-1", "y")]


def test_one_entity_among_many_skips_row_groups(spark, tmp_path):
    from datetime import date

    from pyspark.sql import functions as F

    from tidemark.sources import layers, sinks

    rows = spark.range(4000).select(
        F.format_string("e%05d", F.col("id") * 2).alias("entity_id"), F.lit("m").alias("metric"),
        F.lit(date(2020, 1, 1)).alias("observed_at"), F.lit(2020).alias("year"))

    def scanned(path, entity):
        df = layers.read_layer(spark, path, rows.schema).filter((F.col("year") == 2020) & (F.col("entity_id") == entity))
        found = len(df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, leaf.metrics().apply("numOutputRows").value()

    sinks.write_daily(rows, str(tmp_path / "daily"))
    # inside the bounds of the file, but in none of its rows
    assert scanned(str(tmp_path / "daily"), "e00101") == (0, 0)
    found, read = scanned(str(tmp_path / "daily"), "e00100")
    assert found == 1 and read >= 1
