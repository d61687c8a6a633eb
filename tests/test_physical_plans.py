"""Shape of the physical plans: what must hold whatever the size of the data."""

import os
import re

import pytest

import __spark_entry__ as contract
from tidemark.operators.baseline import day_of_year_stats
from tidemark.operators.daily import daily_entity_metrics
from tidemark.operators.rollup import category_metrics
from tidemark.plans import build
from workload import registry
from workload.tables import CFG, TODAY, tables

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_pairing_of_everything(spark, without_broadcast, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # a window without partition keys would gather its whole input in one task
    assert not re.search(r"windowspecdefinition\((specifiedwindowframe|\w+#\d+L? (ASC|DESC))", plan)


def test_daily_layer_shuffles_its_rows_twice(spark, without_broadcast):
    t = tables(spark, SF_DIR)
    plan = plan_of(daily_entity_metrics(t.daily_stats(), t.baselines(), TODAY))
    keys = r"Exchange hashpartitioning\(entity_id#\d+, metric#\d+, "
    # once for the daily groups and once for the series, beside the baselines' own
    assert len(re.findall(keys + "observed_at", plan)) == 1
    assert len(re.findall(keys + r"\d+\)", plan)) == 2
    assert len(re.findall("Exchange hashpartitioning", plan)) == 5      # two for the input join


def test_baseline_scan_is_narrow_and_filtered(spark):
    plan = plan_of(day_of_year_stats(tables(spark, SF_DIR).raw(), CFG))
    assert "GreaterThanOrEqual(l_shipdate,1995" in plan
    assert "l_orderkey" not in plan and "l_tax" not in plan


def test_risers_are_cut_before_the_shuffle(spark, without_broadcast):
    t = tables(spark, SF_DIR)
    plan = plan_of(category_metrics(t.daily(), t.stations(), CFG))
    final, partial = plan.index("row_number(), 5, Final"), plan.index("row_number(), 5, Partial")
    assert "Exchange hashpartitioning(observed_at" in plan[final:partial]


def test_daily_build_scans_the_raw_rows_once(spark, monkeypatch):
    t, seen = tables(spark, SF_DIR), []
    t.baselines()
    monkeypatch.setattr(build.sinks, "write_daily", lambda df, path: seen.append(df))
    build.build_daily(t.store, t.landed())
    assert len(re.findall(r"FileScan parquet [^\n]*landed", plan_of(seen[0]))) == 1


@pytest.mark.parametrize("name", ["q16_default_date", "a27_coverage_by_day"])
def test_recent_days_prune_to_their_years(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    # the stations are the other scan, without partitions
    pruned = [s for s in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if s]
    assert pruned and all(re.search(r"year#\d+ [<>]= \d{4}", s) for s in pruned)


def test_location_scores_meet_entities_by_id(spark, without_broadcast):
    plan = plan_of(contract.queries()["q24_overlay"](spark, SF_DIR))
    assert not re.search(r"LeftOuter[^\n]*eia_location", plan)
    assert not re.search(r"SortMergeJoin \[eia_location#\d+, period", plan)
