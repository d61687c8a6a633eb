import os
import uuid
from datetime import date, datetime

import pytest

from tidemark import schemas
from tidemark.operators import upsert as u
from tidemark.plans.build import Store, compact_raw, sync_recent, sync_rows, sync_window
from tidemark.sources import sinks

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def row(entity="a", day="2024-01-10", value=1.0, status="Provisional", qualifier=None,
        seen=OLD, unit="u", payload="{}", metric="flow"):
    return ("src", entity, date.fromisoformat(day), seen, metric, f"code-{metric}", value, unit,
            None, None, status, qualifier, payload)


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, schemas.RAW_OBSERVATIONS)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / uuid.uuid4().hex))


def data_files(path):
    """Size of every data file below a folder, by relative path."""
    return {os.path.relpath(os.path.join(at, name), path): os.path.getsize(os.path.join(at, name))
            for at, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def actions(df):
    return {(r.entity_id, r.observed_at.isoformat()): r for r in df.collect()}


def test_actions(frame):
    existing = frame([
        row("same"), row("nan", value=float("nan")), row("filled", value=None),
        row("list", qualifier=["e"]), row("list-null", qualifier=None),
        row("approved"), row("unknown", status=None), row("kept", "2024-01-01"),
        row("nulls", value=None, qualifier=None, unit=None),
    ])
    fetched = frame([
        row("same", seen=NEW, payload="other"), row("nan", value=float("nan"), seen=NEW),
        row("filled", value=2.0, seen=NEW), row("list", qualifier=["e", "r"], seen=NEW),
        row("list-null", qualifier=[], seen=NEW), row("approved", status="Approved", seen=NEW),
        row("unknown", status="Approved", seen=NEW), row("fresh", seen=NEW),
        row("nulls", value=None, qualifier=None, unit=None, seen=NEW),
    ])
    merged = u.upsert(existing, fetched)
    got = {k[0]: r for k, r in actions(merged).items()}
    assert {k: r.action for k, r in got.items()} == {
        "same": "unchanged", "nan": "unchanged", "filled": "updated", "list": "updated",
        "list-null": "updated", "approved": "updated", "unknown": "updated",
        "kept": "untouched", "fresh": "new", "nulls": "unchanged"}
    assert got["same"].collected_at == OLD and got["same"].raw_payload == "{}"
    assert got["filled"].collected_at == NEW and got["filled"].value == 2.0
    assert {k for k, r in got.items() if r.newly_approved} == {"approved"}
    counts = merged.agg(*u.upsert_counts()).first().asDict()
    assert counts == {"new": 1, "updated": 5, "unchanged": 3, "provisional_to_approved": 1}


def test_upsert_is_idempotent(frame):
    fetched = frame([row("a", value=2.0), row("b")])
    once = u.upsert(frame([row("a")]), fetched).drop("action", "newly_approved")
    counts = u.upsert(once, fetched).agg(*u.upsert_counts()).first()
    assert (counts.new, counts.updated, counts.unchanged) == (0, 0, 2)


def test_latest_wins_and_unique(frame):
    kept = u.latest_wins(
        frame([row("a", value=1.0, seen=NEW), row("b", value=1.0)]),
        frame([row("a", value=2.0, seen=OLD), row("b", value=2.0), row("c")]))
    assert {r.entity_id: r.value for r in kept.collect()} == {"a": 1.0, "b": 2.0, "c": 1.0}
    unique = u.unique_observations(frame([row(payload="x"), row(payload="z"), row(payload="y")]))
    assert [r.raw_payload for r in unique.collect()] == ["z"]


def test_fetch_window():
    today = date(2024, 3, 1)
    assert u.fetch_window(today, date(2024, 2, 28)) == (date(2024, 1, 31), today)
    assert u.fetch_window(today, date(2023, 12, 25)) == (date(2023, 12, 23), today)
    assert u.fetch_window(today, None) == (date(2024, 1, 31), today)


def test_sync_replaces_only_touched_partitions(spark, store, frame):
    sinks.write_raw(frame([
        row("a", "2022-06-01"), row("a", "2023-06-01"), row("a", "2024-01-10"),
        row("b", "2024-01-10", metric="stage")]), store.path("raw_observations"))
    files = data_files(store.path("raw_observations"))
    fetched = frame([row("a", "2024-01-10", value=5.0, seen=NEW), row("c", "2024-01-11")])
    since, end = date(2024, 1, 1), date(2024, 1, 31)
    dry = sync_window(store, fetched, since, end, dry_run=True)
    assert dry == {"new": 1, "updated": 1, "unchanged": 0, "provisional_to_approved": 0}
    assert store.raw().filter("value = 5").count() == 0
    assert sync_window(store, fetched, since, end) == dry
    assert store.raw().count() == 5
    written = data_files(store.path("raw_observations")).keys() - files.keys()
    assert {name.split("/")[1:3] == ["metric=flow", "year=2024"] for name in written} == {True}
    again = sync_window(store, fetched, since, end)
    assert (again["new"], again["updated"], again["unchanged"]) == (0, 0, 2)
    counts = {(r.metric, r.year): r.n_rows for r in sinks.partition_counts(store.raw()).collect()}
    assert counts == {("flow", 2022): 1, ("flow", 2023): 1, ("flow", 2024): 2, ("stage", 2024): 1}


def test_sync_starts_from_nothing(store, frame):
    assert sync_rows(store, frame([row("a"), row("b", metric="stage")]))["new"] == 2
    assert sync_recent(store, frame([row("a", "2023-01-01"), row("c", "2024-01-09")]),
                       date(2024, 1, 12))["new"] == 1
    assert store.raw().count() == 3


def test_only_in(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (2,)], "k int")
    assert [r.k for r in u.only_in(left, right, "k").collect()] == [1]


def test_rows_outside_the_window_leave_their_year_intact(spark, tmp_path):
    def rows(year, days, value):
        return [("s", "a", date(year, 1, d), datetime(2024, 2, 1), "flow", "c", value, "u", None, None, "Provisional",
                 None, "{}") for d in days]

    store = Store(spark, str(tmp_path / "store"))
    frame = lambda data: spark.createDataFrame(data, schemas.RAW_OBSERVATIONS)
    sync_rows(store, frame(rows(2022, range(1, 11), 1.0) + rows(2023, range(1, 11), 1.0)))
    counts = sync_window(store, frame(rows(2022, [3], 2.0) + rows(2023, [12], 1.0)), date(2023, 1, 1), date(2023, 12, 31))
    assert (counts["new"], counts["updated"]) == (1, 1)
    years = {r["year"]: r["count"] for r in store.raw().groupBy("year").count().collect()}
    assert years == {2022: 10, 2023: 11}
    from tidemark.session import shared_dir

    shared = shared_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(shared) if x.startswith("staged-")]


def test_rows_without_a_date_are_kept_and_known_again(spark, store):
    def dated(entity, day, value, metric="flow"):
        return ("s", entity, day and date.fromisoformat(day), NEW, metric, "c", value, "u", None, None, "Provisional", None, "{}")

    frame = lambda *rows: spark.createDataFrame(list(rows), schemas.RAW_OBSERVATIONS)
    assert sync_rows(store, frame(dated("E1", None, 2.0)))["new"] == 1
    assert sync_rows(store, frame(dated("E2", None, 3.0)))["new"] == 1
    assert sync_rows(store, frame(dated("E2", None, 3.0)))["new"] == 0
    mixed = frame(dated("E1", None, 5.0), dated("E1", "2024-01-01", 1.0), dated("E3", None, 1.0, None), dated(None, "2024-01-01", 4.0))
    assert sync_rows(store, mixed) == {"new": 3, "updated": 1, "unchanged": 0, "provisional_to_approved": 0}
    assert sync_rows(store, mixed) == {"new": 0, "updated": 0, "unchanged": 4, "provisional_to_approved": 0}
    got = {(r.entity_id, r.observed_at, r.metric): (r.value, r.year) for r in store.raw().collect()}
    day = date(2024, 1, 1)
    assert got == {("E1", None, "flow"): (5.0, None), ("E2", None, "flow"): (3.0, None), ("E1", day, "flow"): (1.0, 2024),
                   ("E3", None, None): (1.0, None), (None, day, "flow"): (4.0, 2024)}
    recent = sync_recent(store, mixed, date(2024, 1, 3))
    assert recent["outside"] == 2 and recent["unchanged"] == 2


def test_upsert_against_brute_force_with_nulls_in_each_key(spark, store):
    import itertools
    import random

    rng, keys = random.Random(6), list(itertools.product(["a", None], ["c", "d", None], ["2023-12-31", "2024-01-01", None]))
    known = {}
    for step in range(4):
        batch = {}
        for entity, code, day in rng.sample(keys, 11):
            batch[entity, code, day] = ("s", entity, day and date.fromisoformat(day), NEW, code, code, float(rng.randint(0, 2)), "u",
                                        None, None, rng.choice([None, "Approved", "Provisional"]), None, f"{step}")
        counts = sync_rows(store, spark.createDataFrame(list(batch.values()), schemas.RAW_OBSERVATIONS))
        changed = {k for k, r in batch.items() if k in known and (known[k][6], known[k][10]) != (r[6], r[10])}
        assert counts["new"] == len(batch.keys() - known.keys()) and counts["updated"] == len(changed)
        assert counts["unchanged"] == len(batch.keys() & known.keys()) - len(changed)
        assert counts["provisional_to_approved"] == sum(known[k][10] == "Provisional" and batch[k][10] == "Approved" for k in changed)
        known |= {k: r for k, r in batch.items() if k in changed or k not in known}
        if step == 2:
            compact_raw(store)
        got = sorted(map(str, (tuple(r)[:13] for r in store.raw().select(*schemas.columns(schemas.RAW_OBSERVATIONS)).collect())))
        assert got == sorted(map(str, known.values()))
    merged = u.upsert(store.raw(), spark.createDataFrame(list(known.values()), schemas.RAW_OBSERVATIONS))
    assert {r.action for r in merged.collect()} == {"unchanged"} and merged.count() == len(known)
