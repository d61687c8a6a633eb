"""Headline timings as one JSON line.

and rollup computed from the stored raw layer and written as Parquet.  Landing that
raw layer from the given tables is timed on its own before.  Both write to a fresh
folder, and the serving queries then read those stored layers, as a user's would.  Two rebuilds at a smaller scale warm the JVM up beforehand; everything
after that is timed once, with all rows produced (no row limits, no caching).
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import build
from tidemark.session import build_session
from workload.registry import QUERIES, spark_query
from workload.tables import CFG, Tables, tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
CPUS = os.environ.get("BENCH_CPUS", "8")

FROM_RAW = ["b01_seasonal_baselines", "a01_daily_stats", "b09_parsed_features", "b10_upsert",
            "b11_stations"]
SERVING = [
    "q01_slice_of_day", "q02_kpi_cards", "q03_top_anomaly_dates", "q04_anomaly_breakdown",
    "q05_monthly_anomaly_counts", "q06_map_data", "q07_region_table", "q08_fastest_risers",
    "q09_hydrograph", "q11_banded_hydrograph", "q13_ranked_flashiness", "q13_flashiness_of_one",
    "q14_personality_cards_of_one", "q15_previous_year", "q16_default_date", "q17_region_states",
    "q18_window_stats", "q19_tight_gauges", "q24_comovement_spans", "q25_next_month_fit",
    "q26_small_multiples", "d01_health_report",
]


def timed(job) -> float:
    began = time.perf_counter()
    job()
    return round(time.perf_counter() - began, 3)


def rebuild(t: Tables) -> None:
    build.rebuild_metrics(t.store, t.landed(), t.stations(), CFG)
    t._built |= {"baselines", "daily", "category"}


def run_query(spark, name: str) -> None:
    spark_query(name)(spark, SF_DIR).write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        # the whole data set is a few megabytes: keep all cores busy anyway
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    })
    spark.sparkContext.setLogLevel("ERROR")
    for _ in range(2):
        rebuild(Tables(spark, WARM_DIR))
    t = tables(spark, SF_DIR)
    seconds = {"land_raw_layer": timed(lambda: (t.landed(), t.stations(), t.monthly()))}
    seconds["rebuild_metrics"] = timed(lambda: rebuild(t))
    seconds["rebuild_coupling"] = timed(lambda: t.pairs())
    for name in [n for n in FROM_RAW + SERVING if n in QUERIES]:
        seconds[name] = timed(lambda: run_query(spark, name))
    raw_rows = t.landed().count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "raw_rows": raw_rows,
        "rebuild_raw_rows_per_second": round(raw_rows / seconds["rebuild_metrics"]),
        "stated_raw_rows_per_second": round(633257 / 3),
    }))


if __name__ == "__main__":
    main()
