"""The given tables in the roles of the library's inputs, and the layers built from them.

Roles:
  raw observations   lineitem by supplier nation and ship date, three metrics: price
                     (whole units), quantity and discount (percent).  Whole numbers
                     keep sums exact, so ties do not depend on the order of addition.
  stations           nation with its region
  monthly series     revenue per location and month, in thousands
  hourly series      mean event value per hour
  revisable rows     events keyed by user, type and day
  station metadata   customers and the dates of their orders
"""

from __future__ import annotations

import hashlib
import threading
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import Settings, schemas
from tidemark.operators import coupling
from tidemark.operators.daily import daily_stats
from tidemark.operators.upsert import latest_wins, unique_observations
from tidemark.plans import build, refresh
from tidemark.session import shared_dir
from tidemark.sources import landed, layers, sinks

CFG = Settings(
    baseline_start=date(1995, 1, 1),
    baseline_end=date(1999, 12, 31),
    # the given values are uniform, whose scores end near 1.7
    extreme_z=1.5,
    flow_metric="price",
    overlay_metric="discount",
    expected_metrics=("price", "quantity", "discount", "tax"),
)
METRIC = "price"
DAY = date(2000, 6, 15)
SPAN = (date(2000, 1, 1), date(2000, 12, 31))
TODAY = date(2001, 11, 10)
ENTITY = "N-7"
FOOTPRINT = ["L-0", "L-1", "L-2"]
SNAPSHOT_END = date(2024, 1, 21)
REFETCH_START = date(2024, 1, 15)
COLLECTED = "2024-02-01 00:00:00"


class Tables:
    """One data folder seen by one session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._given: dict[str, DataFrame] = {}
        self._built: set[str] = set()
        self._lock = threading.RLock()
        self._store: build.Store | None = None

    def given(self, name: str) -> DataFrame:
        if name not in self._given:
            self._given[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._given[name]

    # -- roles -------------------------------------------------------------

    def raw(self) -> DataFrame:
        entities = self.given("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"),
            F.concat(F.lit("N-"), "s_nationkey").alias("entity_id"),
        )
        return (
            self.given("lineitem")
            .select(
                "l_suppkey",
                F.to_date("l_shipdate").alias("observed_at"),
                F.floor("l_extendedprice").cast("double").alias("price"),
                F.col("l_quantity").alias("quantity"),
                F.rint(F.col("l_discount") * 100).alias("discount"),
            )
            .join(entities, "l_suppkey")
            .unpivot(
                ["entity_id", "observed_at"], ["price", "quantity", "discount"], "metric", "value")
        )

    def station_rows(self) -> DataFrame:
        key = F.col("n_nationkey")
        return (
            self.given("nation")
            .join(self.given("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("N-"), key).alias("entity_id"),
                F.col("n_name").alias("station_name"),
                F.concat(F.lit("S-"), (key * key) % 7).alias("state"),
                F.col("r_name").alias("region"),
                (25.0 + key).alias("latitude"),
                (2.0 * key - 120.0).alias("longitude"),
            )
        )

    def locations(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.given("nation").select(
            F.concat(F.lit("N-"), key).alias("entity_id"),
            F.concat(F.lit("L-"), key % 20).alias("eia_location"),
            F.concat(F.lit("Location "), key % 20).alias("eia_location_name"),
            F.when(key < 20, "high").otherwise("low").alias("confidence"),
        )

    def monthly_rows(self) -> DataFrame:
        return (
            self.given("lineitem")
            .join(self.given("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                F.concat(F.lit("L-"), F.col("s_nationkey") % 20).alias("location"),
                F.date_format("l_shipdate", "yyyy-MM").alias("period"),
            )
            .agg((F.sum(F.floor("l_extendedprice")) / 1000.0).alias("generation_thousand_mwh"))
        )

    def hourly(self) -> DataFrame:
        feed = self.given("events").groupBy(
            F.date_trunc("hour", "ts").alias("Interval Start")
        ).agg(F.avg("value").alias("Hydro"))
        return landed.hourly_series(feed)

    def events_raw(self) -> DataFrame:
        """Events in the raw schema; the afternoon readings of a day are approved."""
        qualifier = (
            F.when(F.col("value") < 5, F.array(F.lit("low")))
            .when(F.col("value") > 150, F.array(F.lit("high"), F.lit("e")))
        )
        return self.given("events").select(
            F.lit("events").alias("source"),
            F.concat(F.lit("U-"), "user_id").alias("entity_id"),
            F.to_date("ts").alias("observed_at"),
            F.col("ts").cast("timestamp").alias("collected_at"),
            F.col("event_type").alias("metric"),
            F.col("event_type").alias("parameter_code"),
            "value",
            F.lit("unit").alias("unit"),
            F.lit(None).cast("double").alias("latitude"),
            F.lit(None).cast("double").alias("longitude"),
            F.when(F.hour("ts") >= 12, "Approved").otherwise("Provisional").alias("approval_status"),
            qualifier.alias("qualifier"),
            F.col("props").alias("raw_payload"),
        )

    def snapshot(self) -> DataFrame:
        """Morning readings up to a day: what an earlier load had seen."""
        rows = self.events_raw()
        return rows.filter(
            (F.hour("collected_at") < 12) & (F.col("observed_at") < F.lit(SNAPSHOT_END))
        )

    def refetched(self) -> DataFrame:
        return self.events_raw().filter(F.col("observed_at") >= F.lit(REFETCH_START))

    def pages(self) -> DataFrame:
        """Events as landed feature pages, one JSON document per row."""
        return self.pages_of(F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("U-"), "user_id")).select("page")

    def pages_of(self, time: Column, entity: Column) -> DataFrame:
        feature = F.struct(
            F.struct(
                entity.alias("monitoring_location_id"),
                time.alias("time"),
                F.when(F.col("event_type") == "view", "00060").otherwise(F.col("event_type"))
                .alias("parameter_code"),
                F.when(F.col("event_type") == "error", "n/a")
                .otherwise(F.col("value").cast("string")).alias("value"),
                F.lit("unit").alias("unit_of_measure"),
                F.lit("Provisional").alias("approval_status"),
                F.array(F.lit("e")).alias("qualifier"),
                # a field the library does not know
                F.concat(F.lit("E-"), "event_id").alias("time_series_id"),
            ).alias("properties"),
            F.struct(F.array(F.col("user_id").cast("double"), F.lit(40.5)).alias("coordinates"))
            .alias("geometry"),
        )
        return self.given("events").select(
            "event_id", F.to_json(F.struct(F.array(feature).alias("features"))).alias("page")
        )

    def faulty_pages(self) -> DataFrame:
        """The pages as a careless source lands them: some cut off, some without a date or an entity.

        Every event stays; which fault it gets follows from its number.
        """
        fault = F.col("event_id") % 50
        whole = self.pages_of(F.when(fault != 1, F.date_format("ts", "yyyy-MM-dd")),
                              F.when(fault != 2, F.concat(F.lit("U-"), "user_id")))
        return whole.select(F.when(fault == 0, F.expr("left(page, 60)")).otherwise(F.col("page")).alias("value"))

    def station_features(self) -> DataFrame:
        return self.given("customer").select(
            F.concat(F.lit("C-"), "c_custkey").alias("id"),
            F.struct(
                F.lit(None).cast("string").alias("id"),
                F.col("c_name").alias("monitoring_location_name"),
                F.when(F.col("c_mktsegment") == "MACHINERY", "Oregon").alias("state_name"),
                F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0").alias("state_code"),
                F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("hydrologic_unit_code"),
                F.lit("Stream").alias("site_type"),
                F.lit("X").alias("agency_code"),
                F.col("c_acctbal").alias("drainage_area"),
            ).alias("properties"),
            F.struct(F.array(F.col("c_nationkey").cast("double"), F.lit(41.25)).alias("coordinates"))
            .alias("geometry"),
        )

    def series_periods(self) -> DataFrame:
        end = F.date_add(F.to_date("o_orderdate"), F.floor(F.col("o_totalprice") / 1000).cast("int"))
        return self.given("orders").select(
            F.concat(F.lit("C-"), "o_custkey").alias("monitoring_location_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("begin_utc"),
            end.cast("string").alias("end_utc"),
        )

    def curated(self) -> DataFrame:
        return self.given("customer").select(
            F.concat(F.lit("C-"), "c_custkey").alias("entity_id"),
            F.when(F.col("c_mktsegment") == "BUILDING", "Curated").otherwise("").alias("region"),
        )

    # -- derived frames ----------------------------------------------------

    def daily_stats(self) -> DataFrame:
        return daily_stats(self.raw())

    def monthly_extension(self) -> DataFrame:
        return coupling.daily_to_monthly(coupling.hourly_to_daily(self.hourly()), CFG)

    def generation_base(self) -> DataFrame:
        return coupling.generation_base(self.monthly(), self.locations())

    def generation(self) -> DataFrame:
        return coupling.extend_generation(
            self.generation_base(), self.monthly_extension(),
            coupling.entities_at(self.locations(), FOOTPRINT),
            coupling.newest_month(self.monthly(), self.locations()),
        )

    # -- stored layers -----------------------------------------------------

    @property
    def store(self) -> build.Store:
        """Layer folder of this session and data folder, under the shared folder."""
        if self._store is None:
            tag = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:10]
            app = self.spark.sparkContext.applicationId
            self._store = build.Store(self.spark, f"{shared_dir(self.spark)}/layers-{app}-{tag}")
        return self._store

    def _once(self, name: str, job) -> None:
        with self._lock:
            if name not in self._built:
                job()
                self._built.add(name)

    def stations(self) -> DataFrame:
        """The station dimension as a stored table, so that its size is known to the planner."""
        path = self.store.path("stations")
        self._once("stations", lambda: sinks.write_table(self.station_rows(), path))
        return layers.read_table(self.spark, path, self.station_rows().schema)

    def monthly(self) -> DataFrame:
        """The second measure as a stored table."""
        path = self.store.path("monthly")
        self._once("monthly", lambda: sinks.write_table(self.monthly_rows(), path))
        return layers.read_table(self.spark, path, schemas.MONTHLY_GENERATION)

    def landed(self) -> DataFrame:
        """The raw observations as a stored layer, as an ingest would leave them.

        Only the bench reads it: building two layers straight from the given tables
        costs less than writing three rows per reading first.
        """
        path = self.store.path("landed")
        self._once("landed", lambda: sinks.write_raw(self.raw(), path))
        return layers.read_layer(self.spark, path, self.raw().schema)

    def baselines(self) -> DataFrame:
        self._once("baselines", lambda: build.build_baselines(self.store, self.raw(), CFG))
        return self.store.baselines()

    def daily(self) -> DataFrame:
        self.baselines()
        self._once("daily", lambda: build.build_daily(self.store, self.raw()))
        return self.store.daily()

    def category(self) -> DataFrame:
        self.daily()
        self._once("category", lambda: build.build_category(self.store, self.stations(), CFG))
        return self.store.category()

    def _coupling(self) -> build.Store:
        self.daily()
        self._once("coupling", lambda: build.rebuild_coupling(
            self.store, self.generation(), self.locations(), CFG))
        return self.store

    def pairs(self) -> DataFrame:
        return self._coupling().pairs()

    def correlation_raw(self) -> DataFrame:
        return self._coupling().correlation_raw()

    def correlation_final(self) -> DataFrame:
        return self._coupling().correlation_final()

    def raw_layer(self) -> build.Store:
        """A raw layer on disk: the morning snapshot, then the re-fetch merged into it."""
        def job() -> None:
            empty = self.spark.createDataFrame([], schemas.RAW_OBSERVATIONS)
            sinks.write_raw(
                latest_wins(empty, self.snapshot()), self.store.path("raw_observations"))
            refresh.refresh_profile(self.store)
            build.sync_rows(self.store, unique_observations(self.refetched()))
            refresh.refresh_profile(self.store)

        self._once("raw_layer", job)
        return self.store


    def page_stream(self) -> build.Store:
        """The faulty pages landed as files, then streamed into a store of their own."""
        target = build.Store(self.spark, self.store.path("from_pages"))

        def job() -> None:
            from tidemark.streaming.landing import landed_pages, upsert_page_stream

            landing = self.store.path("landing_pages")
            self.faulty_pages().repartition(6, "value").write.mode("overwrite").text(landing)
            stream = landed_pages(self.spark, landing, files_per_batch=2, page_per_line=True)
            upsert_page_stream(
                stream, target, self.store.path("page_progress"), compact_after=2,
                collected_at=F.lit(COLLECTED)).awaitTermination()

        self._once("page_stream", job)
        return target


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The same object for the same session and folder, so layers are built once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, sf_dir)
    return _OPEN[key]
