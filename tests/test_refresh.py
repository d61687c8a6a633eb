"""State, baselines and daily layer after upserts, against a full rebuild."""

import math
import random
from datetime import date, datetime, timedelta

import pytest

from tests.test_versions import bytes_below
from tidemark import Settings, schemas
from tidemark.operators.baseline import baselines_of, day_of_year_stats, merged_stats, seasonal_baselines
from tidemark.operators.daily import daily_entity_metrics, daily_stats, newest_observed
from tidemark.plans import refresh
from tidemark.plans.quality import health_report, raw_profile, report_of
from tidemark.plans.build import Store, compact_raw, sync_rows

CFG = Settings(baseline_start=date(2019, 1, 1), baseline_end=date(2022, 12, 31))


def rows(values):
    return [("s", e, d, datetime(2024, 1, 1), m, m, v, "u", None, None, "Provisional", None, "{}") for (e, m, d), v in values.items()]


def sync(store, values):
    return sync_rows(store, store.spark.createDataFrame(rows(values), schemas.RAW_OBSERVATIONS))


def same(got, want, key):
    def keyed(df):
        return {tuple(r[k] for k in key): r for r in df.collect()}

    got, want = keyed(got.select(*want.columns)), keyed(want)
    assert got.keys() == want.keys()
    for k, row in want.items():
        for a, b in zip(got[k], row, strict=True):
            assert a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (k, got[k], row)


def agrees(store, today=None):
    raw = store.raw()
    known = seasonal_baselines(raw, CFG)
    same(store.baselines(), known, ["entity_id", "metric", "day_of_year"])
    daily = daily_entity_metrics(daily_stats(raw), known, today or newest_observed(raw))
    same(store.daily(), daily, ["entity_id", "metric", "observed_at"])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_three_upserts_equal_a_rebuild(store):
    rng, first = random.Random(9), date(2021, 6, 1)
    values = {(f"e{e}", m, first + timedelta(days=rng.randrange(700))): round(rng.gauss(1e4, 5), 2)
              for e in range(12) for m in ("flow", "stage") for _ in range(60)}
    sync(store, values)
    assert refresh.refresh(store, CFG) == {"series": -1, "slots": -1}
    agrees(store)
    whole = bytes_below(store.path("daily_entity_metrics"))
    # new values, revised ones, one that is lost, a new series; then the newest day moves on; then nothing
    steps = [
        {("e1", "flow", date(2021, 6, 5)): 1.5, ("e1", "flow", date(2025, 1, 1)): None},
        {k: (None if n == 2 else 7.0 + n) for n, k in enumerate(sorted(k for k in values if k[0] == "e2")[:5])},
        {("new", "flow", date(2022, 2, 28)): 3.0, ("e3", "stage", date(2023, 9, 9)): 4.0, (None, "flow", date(2022, 1, 1)): 1.0},
        {("e1", None, date(2022, 1, 1)): 2.0, ("e1", "flow", None): 2.0},
    ]
    touched = [1, 1, 3, 1]
    refresh.refresh_profile(store)
    for k, (step, n) in enumerate(zip(steps, touched, strict=True)):
        sync(store, step)
        if k == 1:
            sync(store, {next(iter(step)): 70.0})  # changed twice between two refreshes
        before = bytes_below(store.path("daily_entity_metrics"))
        assert refresh.refresh(store, CFG)["series"] == n
        agrees(store)
        if k != 1:
            refresh.refresh_profile(store)
            same(store.profile(), raw_profile(store.raw()), ["entity_id", "metric"])
        if k < 2:
            assert bytes_below(store.path("daily_entity_metrics")) - before < whole / 4
        if k == 2:
            refresh.compact(store, CFG)
            compact_raw(store)
            agrees(store)
    refresh.refresh_profile(store)
    known = store.raw().select("entity_id").distinct().filter("entity_id is not null")
    rest = (store.daily(), store.daily().limit(0), known.union(known.limit(1).selectExpr("'lacking'")), date(2023, 9, 20), CFG)
    whole, stored = (sorted(map(str, r.collect())) for r in (health_report(store.raw(), *rest), report_of(store.profile(), *rest)))
    assert whole == stored and any("lacking" in x for x in whole)
    assert refresh.refresh(store, CFG) == {"series": 0, "slots": 0}
    assert refresh.refresh(store, CFG, date(2024, 2, 2)) == {"series": 0, "slots": 0}
    agrees(store, date(2024, 2, 2))


def test_only_the_folders_and_rows_of_touched_series_are_written(spark, store):
    values = {(f"e{e}", "flow", date(2021 + y, 1, 1) + timedelta(days=7 * w)): float(e + w) for e in range(30) for y in range(3) for w in range(50)}
    sync(store, values)
    refresh.refresh(store, CFG)
    days = store.daily().filter("entity_id = 'e4'").count()
    sync(store, {("e4", "flow", date(2023, 1, 3)): 9.0})
    refresh.refresh(store, CFG)
    layer = store.daily_files().version().layers[-1][0]
    written = spark.read.parquet(f"{store.path('daily_entity_metrics')}/gen={layer:06d}")
    assert written.count() == days and {r[0] for r in written.select("entity_id").distinct().collect()} == {"e4"}
    slots = store.state_files().version().layers
    assert not slots  # 2023 lies behind the baseline window
    sync(store, {("e4", "flow", date(2022, 1, 3)): 9.0})
    assert refresh.refresh(store, CFG) == {"series": 1, "slots": 1}
    layer = store.state_files().version().layers[-1][0]
    assert spark.read.parquet(f"{store.path('baseline_state')}/gen={layer:06d}").count() == 1


def test_what_cannot_be_laid_over_is_rebuilt(store):
    sync(store, {("a", "flow", date(2022, 1, 1)): 1.0, ("b", "flow", date(2022, 1, 2)): 2.0})
    refresh.refresh(store, CFG)
    sync(store, {("a", "flow", date(2022, 1, 1)): None})
    assert refresh.refresh(store, CFG)["series"] == -1
    agrees(store)
    assert refresh.refresh(store, Settings(baseline_start=date(2000, 1, 1), baseline_end=CFG.baseline_end))["series"] == -1
    sync(store, {("b", "flow", date(2022, 1, 3)): 2.0})
    compact_raw(store)  # before the change was taken up
    assert refresh.refresh(store, CFG)["series"] == -1
    agrees(store)


def test_moments_merge_like_those_of_all_rows(spark, readings):
    rng = random.Random(2)
    data = [(e, "m", date(2020, 1, 1) + timedelta(days=rng.randrange(900)), rng.gauss(1e6, 1)) for e in "ab" for _ in range(300)]
    one, two = (day_of_year_stats(readings(part), CFG) for part in (data[:400], data[400:]))
    merged = baselines_of(merged_stats(one, two, CFG), CFG)
    got, want = ({(r.entity_id, r.day_of_year): r for r in df.collect()} for df in (merged, seasonal_baselines(readings(data), CFG)))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].n_years == r.n_years
        assert (r.sigma is None) == (got[k].sigma is None) and (r.sigma is None or math.isclose(got[k].sigma, r.sigma, rel_tol=1e-6))
