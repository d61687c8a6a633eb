"""Replacement without a hole, layers over folders, and folding."""

import os
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.build import Store, compact_raw, sync_rows
from tidemark.sources import layers, sinks
from tidemark.sources.versions import Versioned

SCHEMA = "entity_id string, metric string, observed_at date, region string, year int"


def numbered(spark, n, entity="e"):
    return spark.range(n).select(
        F.concat(F.lit(entity), "id").alias("entity_id"), F.lit("m").alias("metric"), F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int") * 90).alias("observed_at"),
        F.lit("r").alias("region")).withColumns({"year": F.year("observed_at"), "date": F.col("observed_at")})


def failing(df):
    """The same rows, but one of them can't be computed, which shows only while they are written."""
    broken = F.when(F.col("entity_id").endswith("99"), F.raise_error(F.lit("lost"))).otherwise(F.col("region"))
    return df.repartition(4).sortWithinPartitions("entity_id").withColumn("region", broken.cast("string"))


WRITERS = {
    "daily": (sinks.write_daily, layers.read_layer),
    "category": (sinks.write_category, layers.read_layer),
    "raw": (sinks.write_raw, layers.read_layer),
    "touched": (lambda df, path: sinks.write_raw(df, path, only_touched=True), layers.read_layer),
    "table": (lambda df, path: sinks.write_table(df, path, ["entity_id"]), layers.read_table),
    "csv": (sinks.write_csv, layers.read_dimension),
}


@pytest.mark.parametrize("kind", sorted(WRITERS))
def test_a_failed_rewrite_leaves_the_old_rows(spark, tmp_path, kind):
    write, read = WRITERS[kind]
    path, rows = str(tmp_path / "frame"), numbered(spark, 100)
    schema = rows.schema
    write(rows, path)
    before = read(spark, path, schema)
    with pytest.raises(PySparkException):
        write(failing(numbered(spark, 100, "new")), path)
    assert {r[0][0] for r in read(spark, path, schema).select("entity_id").collect()} == {"e"}
    assert read(spark, path, schema).count() == 100
    # a reader that opened the frame before the rewrite reads on while and after it happens
    write(numbered(spark, 100, "new"), path)
    assert before.count() == 100
    after = read(spark, path, schema)
    assert after.count() == 100 and after.filter("entity_id like 'new%'").count() == 100


def test_old_generations_go_with_the_second_write(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(1, 5):
        sinks.write_table(numbered(spark, n), path)
        assert layers.read_table(spark, path, numbered(spark, 1).schema).count() == n
    assert sorted(x for x in os.listdir(path) if x.startswith("gen=")) == ["gen=000003", "gen=000004"]


def test_empty_frames_and_plain_folders(spark, tmp_path):
    rows = numbered(spark, 3)
    for kind, (write, read) in WRITERS.items():
        write(rows.limit(0), str(tmp_path / kind))
        assert read(spark, str(tmp_path / kind), rows.schema).count() == 0
    rows.write.partitionBy("metric", "year").parquet(str(tmp_path / "plain"))
    assert layers.read_layer(spark, str(tmp_path / "plain"), rows.schema).count() == 3


def row(entity, day, value, seen=1, metric="flow", code="c", payload="{}"):
    return ("s", entity, date.fromisoformat(day) if day else None, datetime(2024, 2, seen), metric, code, value, "u", None,
            None, "Provisional", None, payload)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_OBSERVATIONS)


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(at, x)) for at, _, names in os.walk(path) for x in names if x.endswith(".parquet"))


def test_a_batch_writes_what_it_changes_and_folding_changes_no_row(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = store.path("raw_observations")
    big = spark.range(60_000).select(
        F.lit("s").alias("source"), F.concat(F.lit("e"), F.col("id") % 200).alias("entity_id"),
        F.date_add(F.lit(date(2023, 1, 1)), (F.col("id") / 200).cast("int")).alias("observed_at"),
        F.lit(datetime(2024, 1, 1)).alias("collected_at"), F.lit("flow").alias("metric"), F.lit("c").alias("parameter_code"),
        F.rand(3).alias("value"), F.lit("u").alias("unit"), F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), F.lit("Provisional").alias("approval_status"),
        F.lit(None).cast("array<string>").alias("qualifier"), F.sha2(F.col("id").cast("string"), 256).alias("raw_payload"))
    assert sync_rows(store, big)["new"] == 60_000
    assert compact_raw(store) == 1 and compact_raw(store) == 0
    whole = bytes_below(path)
    for day, value, action in (("2023-03-01", 7.0, "updated"), ("2023-12-30", 8.0, "new"), (None, 9.0, "new")):
        before = bytes_below(path)
        assert sync_rows(store, frame(spark, [row("e5", day, value)]))[action] == 1
        assert bytes_below(path) - before < whole / 100
    assert sync_rows(store, frame(spark, [row("e5", None, 9.0)]))["new"] == 0
    before = sorted(map(str, store.raw().collect()))
    assert len(before) == 60_002 and len(store.raw_files().version().layers) == 3
    assert compact_raw(store) == 2
    assert sorted(map(str, store.raw().collect())) == before and store.raw_files().version().layers == []


def test_layers_that_only_add_and_single_folders(spark, tmp_path):
    target = Versioned(spark, str(tmp_path / "x"), sinks.LAYOUT)
    schema = layers.with_partitions(numbered(spark, 1).schema, sinks.LAYOUT)
    save = sinks.save_layer(["entity_id"])
    target.replace(target.write(numbered(spark, 9), save))
    target.lay_over(target.write(numbered(spark, 2, "more"), save), [])
    assert target.read(schema).count() == 11
    with pytest.raises(ValueError, match="fold"):
        target.replace(target.write(numbered(spark, 1), save), only_touched=True)
    target.fold(schema, save)
    assert target.read(schema).count() == 11
    target.replace(target.write(numbered(spark, 1, "only"), save), only_touched=True)
    # the 90-day steps put 5 of the first 9 rows and both later ones into 2020
    assert target.read(schema).count() == 11 - 7 + 1
    plan = target.read(schema).filter("year = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
