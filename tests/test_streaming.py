import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.upsert import latest_wins, newest_revisions
from tidemark.plans.build import Store
from tidemark.sources.landed import judged_rows
from tidemark.sources.sinks import write_raw
from tidemark.streaming.landing import landed_observations, landed_pages, upsert_page_stream, upsert_stream


def rows(value, seen, days):
    return [("s", "a", date(2024, 1, d), seen, "flow", "c", value, "u", None, None, "Provisional",
             None, "{}") for d in days]


def test_two_batches_equal_one_load(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    progress = str(tmp_path / "progress")
    first = spark.createDataFrame(rows(1.0, datetime(2024, 2, 1), range(1, 6)), schemas.RAW_OBSERVATIONS)
    second = spark.createDataFrame(rows(2.0, datetime(2024, 2, 2), range(4, 9)), schemas.RAW_OBSERVATIONS)
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(landing)
        stream = landed_observations(spark, landing, files_per_batch=1)
        upsert_stream(stream, store, progress).awaitTermination()
    want = {r.observed_at: r.value for r in latest_wins(first, second).collect()}
    got = {r.observed_at: r.value for r in store.raw().collect()}
    assert got == want and len(got) == 8
    # nothing has landed since: running again processes no batch and changes nothing
    upsert_stream(landed_observations(spark, landing), store, progress).awaitTermination()
    assert {r.observed_at: r.value for r in store.raw().collect()} == want


def test_batches_and_order_of_files_do_not_matter(spark, tmp_path):
    def row(day, value, seen, payload):
        return ("s", "a", date(2023 + day % 2, 1, day), datetime(2024, 2, seen), "flow", "c", value, "u", None, None,
                "Provisional", None, payload)

    # payload texts sort against time; the third file is older than the second
    files = [[row(1, 1.0, 1, "z"), row(2, 5.0, 4, "b")], [row(1, 2.0, 3, "a"), row(2, 6.0, 2, "y")],
             [row(1, 1.0, 2, "y"), row(3, 7.0, 1, "x")]]
    outcomes = set()
    for k, (order, per_batch) in enumerate([((0, 1, 2), 1), ((2, 1, 0), 1), ((1, 2, 0), 2), ((0, 1, 2), None)]):
        landing, store = str(tmp_path / f"landing{k}"), Store(spark, str(tmp_path / f"store{k}"))
        for at in order:
            spark.createDataFrame(files[at], schemas.RAW_OBSERVATIONS).coalesce(1).write.mode("append").parquet(landing)
            if per_batch != 2:
                stream = landed_observations(spark, landing, per_batch)
                upsert_stream(stream, store, str(tmp_path / f"progress{k}")).awaitTermination()
        upsert_stream(landed_observations(spark, landing), store, str(tmp_path / f"progress{k}")).awaitTermination()
        outcomes.add(tuple(sorted((r.observed_at, r.value, r.raw_payload) for r in store.raw().collect())))
    assert outcomes == {((date(2023, 1, 2), 5.0, "b"), (date(2024, 1, 1), 2.0, "a"), (date(2024, 1, 3), 7.0, "x"))}


def test_a_bad_page_is_put_aside_and_the_others_land(spark, tmp_path):
    def feature(**changes):
        properties = {"monitoring_location_id": "a", "time": "2024-01-01", "parameter_code": "00060", "value": "1.5"} | changes
        return {"properties": {k: v for k, v in properties.items() if v is not None}, "geometry": {"coordinates": [1, 2]}}

    def page(*features):
        return json.dumps({"features": list(features)}, indent=1)

    landing = tmp_path / "landing"
    landing.mkdir()
    pages = {
        "good": page(feature(), feature(time="2024-01-02", value="n/a", extra={"x": 1})), "cut": page(feature(value="9"))[:-20],
        "undated": page(feature(time=None), feature(time="someday"), feature(time="2024-01-03")), "list": "[1, 2]",
        "other": '{"type": "x"}', "nobody": page(feature(monitoring_location_id=None), feature(parameter_code=None)), "none": page(),
    }
    for name, text in pages.items():
        (landing / f"{name}.json").write_text(text)
    store, progress = Store(spark, str(tmp_path / "store")), str(tmp_path / "progress")

    def run():
        stream = landed_pages(spark, str(landing), files_per_batch=3)
        upsert_page_stream(stream, store, progress, compact_after=2).awaitTermination()

    run()
    (landing / "later.json").write_text(page(feature(value="2.5"), feature(time="2024-02-01")))
    run()
    run()
    got = {(r.entity_id, r.observed_at.isoformat()): r.value for r in store.raw().collect()}
    assert got == {("a", "2024-01-01"): 2.5, ("a", "2024-01-02"): None, ("a", "2024-01-03"): 1.5, ("a", "2024-02-01"): 1.5}
    rejected = sorted((r.path.rsplit("/", 1)[1], r.reason) for r in store.rejected().collect())
    assert rejected == [("cut.json", "malformed page"), ("list.json", "malformed page"), ("nobody.json", "no entity"),
                        ("nobody.json", "no parameter"), ("other.json", "no features"), ("undated.json", "no date"),
                        ("undated.json", "no date")]
    assert [r.content for r in store.rejected().filter("reason = 'malformed page' and path like '%cut%'").collect()] == [pages["cut"]]


def test_pages_of_many_batches_against_plain_computation(spark, tmp_path, monkeypatch):
    def kept_in_memory(*_):
        raise AssertionError("pages of a batch must not fill the memory that its sorts need")

    monkeypatch.setattr(type(spark.range(0)), "persist", kept_in_memory)
    landing = tmp_path / "landing"
    landing.mkdir()
    good, bad = {}, []
    for k in range(5):
        lines = []
        for i in range(40):
            p = {"monitoring_location_id": f"e{i % 7}", "time": f"2024-01-{1 + (i + k) % 5:02d}", "parameter_code": "00060", "value": str(k * i % 13)}
            lacks = {11: "monitoring_location_id", 12: "parameter_code", 13: "time"}.get(i)
            p.pop(lacks, None)
            text = json.dumps(p, separators=(",", ":"))
            page = '{"features":[{"properties":' + text + ',"geometry":null}]}'
            if lacks:
                bad.append(({"monitoring_location_id": "no entity", "parameter_code": "no parameter", "time": "no date"}[lacks], text))
            elif i == 14:
                page = page[:30]  # the same in every file, and each time a reject
                bad.append(("malformed page", page))
            else:
                key = (p["monitoring_location_id"], p["time"])
                good[key] = max(good.get(key, ""), text)
            lines.append(page)
        lines += ['{"features":[]}', '{"features":[null]}', '{"features":null}']
        bad += [("no entity", None), ("no features", '{"features":null}')]
        (landing / f"{k}.json").write_text("\n".join(lines) + "\n")
    store = Store(spark, str(tmp_path / "store"))
    stream = landed_pages(spark, str(landing), files_per_batch=1, page_per_line=True)
    seen = F.lit("2024-02-01").cast("timestamp")
    upsert_page_stream(stream, store, str(tmp_path / "progress"), compact_after=3, collected_at=seen).awaitTermination()
    rows = store.raw().collect()
    assert {(r.entity_id, r.observed_at.isoformat()): r.raw_payload for r in rows} == good and len(rows) == len(good)
    assert all(r.value == float(json.loads(r.raw_payload)["value"]) for r in rows)
    rejected = store.rejected().collect()
    assert sorted(map(repr, ((r.reason, r.content) for r in rejected))) == sorted(map(repr, bad))
    assert {r.batch_id for r in rejected} == set(range(5)) and all(r.path.endswith(".json") for r in rejected)


def nodes(plan):
    found = [plan]
    for i in range(plan.children().size()):
        found += nodes(plan.children().apply(i))
    return found


def test_a_revision_is_sorted_and_shuffled_with_its_payload_once(spark):
    rows = newest_revisions(spark.createDataFrame([], schemas.RAW_OBSERVATIONS))
    sums = [n for n in nodes(rows._jdf.queryExecution().sparkPlan()) if "Aggregate" in n.nodeName()]
    assert len(sums) == 2 and all(n.schema().json().count('"raw_payload"') == 1 for n in sums)


def test_rows_of_the_newest_layer_meet_no_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def land(value, seen, days):
        landing = str(tmp_path / "landing")
        spark.createDataFrame(rows(value, seen, days), schemas.RAW_OBSERVATIONS).coalesce(1).write.mode("append").parquet(landing)
        upsert_stream(landed_observations(spark, landing), store, str(tmp_path / "progress")).awaitTermination()
        return store.raw()

    only = land(1.0, datetime(2024, 2, 1), range(1, 6))
    assert not [n for n in nodes(only._jdf.queryExecution().sparkPlan()) if "Join" in n.nodeName()]
    land(2.0, datetime(2024, 2, 2), range(4, 9))
    three = land(0.5, datetime(2024, 2, 3), range(8, 10))
    assert {r.observed_at.day: r.value for r in three.collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 2.0, 7: 2.0, 8: 0.5, 9: 0.5}
    assert three.count() == 9 and len(store.raw_files().version().layers) == 3


def test_a_page_and_its_properties_are_parsed_once_for_rows_and_rejects(spark):
    pages = spark.range(3).selectExpr("'{}' || id AS page", "'p' || id AS path")
    judged = judged_rows(pages, datetime(2024, 2, 1))
    plan = newest_revisions(judged, apart=("reason",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2


def test_a_layer_of_one_folder_is_written_by_several_tasks(spark, tmp_path):
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 256) for k in "ab"])
    some = spark.range(100_000).select(
        F.lit("s").alias("source"), F.concat(F.lit("e"), F.col("id") % 5000).alias("entity_id"), F.lit(date(2024, 1, 1)).alias("observed_at"),
        F.lit("flow").alias("metric"), F.col("id").cast("string").alias("parameter_code"), text.alias("raw_payload"))
    write_raw(schemas.conform(some.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RAW_OBSERVATIONS if f.name not in some.columns]), schemas.RAW_OBSERVATIONS), str(tmp_path / "store" / "raw_observations"))
    stored = Store(spark, str(tmp_path / "store")).raw()
    assert len(list(tmp_path.glob("store/raw_observations/gen=*/metric=flow/year=2024/*.parquet"))) > 1
    assert stored.count() == 100_000 and stored.select("entity_id").distinct().count() == 5000
    # all rows of a series lie in one file, in order
    placed = stored.select("entity_id", F.input_file_name().alias("file")).distinct().groupBy("entity_id").agg(F.count("*").alias("files"))
    assert placed.filter("files > 1").isEmpty()


def test_keys_of_the_oldest_rows_are_not_asked_for(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for value, seen, days in ((1.0, datetime(2024, 2, 1), range(1, 6)), (2.0, datetime(2024, 2, 2), range(4, 9))):
        landing = str(tmp_path / "landing")
        spark.createDataFrame(rows(value, seen, days), schemas.RAW_OBSERVATIONS).coalesce(1).write.mode("append").parquet(landing)
        upsert_stream(landed_observations(spark, landing), store, str(tmp_path / "progress")).awaitTermination()
    version = store.raw_files().version()
    assert not version.parts and len(version.layers) == 2
    found = store.raw()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[plan.index("Aggregate"):]
    assert f"= {version.layers[1][0]})" in aggregate and " IN (" not in aggregate
    assert {r.observed_at.day: r.value for r in found.collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 2.0, 7: 2.0, 8: 2.0}
