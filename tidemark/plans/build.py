"""Jobs that turn one stored layer into the next.  All of them write."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import coupling
from tidemark.operators.baseline import seasonal_baselines, state_schema
from tidemark.operators.daily import daily_entity_metrics, daily_stats, newest_observed
from tidemark.operators.rollup import category_metrics
from tidemark.operators.upsert import fetch_window, newer_revisions, upsert_counts, upserted_rows
from tidemark.session import remove, shared_dir
from tidemark.settings import Settings
from tidemark.sources import layers, sinks
from tidemark.sources.versions import Versioned, touching


@dataclass(frozen=True)
class Store:
    """Where the layers live."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def raw(self) -> DataFrame:
        """The raw rows: those of the folders, and over them what later batches brought."""
        return layers.read_layer(
            self.spark, self.path("raw_observations"), schemas.RAW_OBSERVATIONS)

    def raw_files(self) -> Versioned:
        return Versioned(self.spark, self.path("raw_observations"), sinks.LAYOUT)

    def ensure_raw(self) -> Store:
        """Create an empty raw layer unless there is one."""
        if self.raw_files().version() is None:
            sinks.write_raw(self.spark.createDataFrame([], schemas.RAW_OBSERVATIONS), self.path("raw_observations"))
        return self

    def rejected(self) -> DataFrame:
        """Pages and features that a load of pages left out, with the reason."""
        files = self.rejected_files()
        return files.read(schemas.REJECTED) if files.version() else self.spark.createDataFrame([], schemas.REJECTED)

    def rejected_files(self) -> Versioned:
        return Versioned(self.spark, self.path("rejected"))

    def profile(self) -> DataFrame:
        """The stored profile of the raw rows, see :func:`tidemark.plans.refresh.refresh_profile`."""
        rows = self.profile_files().read(schemas.RAW_PROFILE)
        return rows.groupBy("entity_id", "metric").agg(
            *[F.sum(c).alias(c) for c in ("n", "no_date", "no_value")], F.max("newest").alias("newest"))

    def profile_files(self) -> Versioned:
        return Versioned(self.spark, self.path("raw_profile"))

    def baseline_state(self, cfg: Settings = Settings()) -> DataFrame:
        """Moments per series and day-of-year; slots that lost all rows are left out."""
        return self.state_files().read(state_schema(cfg)).filter("n > 0")

    def state_files(self) -> Versioned:
        return Versioned(self.spark, self.path("baseline_state"), ["metric"])

    def baseline_files(self) -> Versioned:
        return Versioned(self.spark, self.path("seasonal_baselines"))

    def daily_files(self) -> Versioned:
        return Versioned(self.spark, self.path("daily_entity_metrics"), sinks.LAYOUT)

    def baselines(self) -> DataFrame:
        return layers.read_table(
            self.spark, self.path("seasonal_baselines"), schemas.SEASONAL_BASELINES)

    def daily(self) -> DataFrame:
        return layers.read_layer(
            self.spark, self.path("daily_entity_metrics"), schemas.DAILY_ENTITY_METRICS)

    def category(self) -> DataFrame:
        return layers.read_layer(
            self.spark, self.path("daily_category_metrics"), schemas.DAILY_CATEGORY_METRICS)

    def pairs(self) -> DataFrame:
        return layers.read_table(self.spark, self.path("aligned_pairs"), schemas.ALIGNED_PAIRS)

    def correlation_raw(self) -> DataFrame:
        return layers.read_dimension(
            self.spark, self.path("correlation_raw"), schemas.CORRELATION_RAW)

    def correlation_final(self) -> DataFrame:
        return layers.read_dimension(
            self.spark, self.path("correlation_final"), schemas.CORRELATION_FINAL)


def build_baselines(store: Store, raw: DataFrame, cfg: Settings = Settings()) -> None:
    sinks.write_table(
        seasonal_baselines(raw, cfg), store.path("seasonal_baselines"),
        ["entity_id", "metric", "day_of_year"],
    )


def build_daily(store: Store, raw: DataFrame, today: date | None = None) -> None:
    """Daily layer from raw rows and the stored baselines."""
    sinks.write_daily(
        daily_entity_metrics(daily_stats(raw), store.baselines(), today or newest_observed(raw)),
        store.path("daily_entity_metrics"),
    )


def build_category(
    store: Store, stations: DataFrame, cfg: Settings = Settings(), today: date | None = None
) -> None:
    sinks.write_category(
        category_metrics(store.daily(), stations, cfg, today),
        store.path("daily_category_metrics"),
    )


def rebuild_metrics(
    store: Store, raw: DataFrame, stations: DataFrame, cfg: Settings = Settings(),
    today: date | None = None,
) -> None:
    """Baselines, daily layer and rollup, each stored before the next reads it."""
    build_baselines(store, raw, cfg)
    build_daily(store, raw, today)
    build_category(store, stations, cfg)


def rebuild_coupling(
    store: Store, generation: DataFrame, locations: DataFrame, cfg: Settings = Settings()
) -> None:
    """Aligned pairs and both correlation tables from the stored daily layer."""
    pairs = coupling.aligned_pairs(
        coupling.flow_monthly(store.daily(), cfg), generation, locations)
    sinks.write_table(pairs, store.path("aligned_pairs"), ["entity_id", "period"])
    raw = coupling.correlation_raw(store.pairs(), store.baselines(), locations, cfg)
    sinks.write_csv(raw, store.path("correlation_raw"))
    sinks.write_csv(
        coupling.correlation_final(store.correlation_raw()), store.path("correlation_final"))


def sync_window(
    store: Store, fetched: DataFrame, since: date, end: date, dry_run: bool = False
) -> dict[str, int]:
    """Upsert the rows fetched for [since, end], and any beyond.

    Only what is new or changed is written, as a layer over the stored rows (see :func:`compact_raw`); what is written
    grows with the batch and not with the folders it falls into.  Rows without a date or metric have a folder
    of their own (``__HIVE_DEFAULT_PARTITION__``), in which the key alone tells them apart.
    """
    return _merge(store, fetched, dry_run)


def sync_recent(
    store: Store, fetched: DataFrame, today: date, cfg: Settings = Settings()
) -> dict[str, int]:
    """Upsert the default window: recent revisions plus days after the last one.

    Rows outside the window or without a date are left out and counted as ``outside``.
    """
    newest = store.ensure_raw().raw().agg(F.max("observed_at").alias("d")).first()["d"]
    since, end = fetch_window(today, newest, cfg.revision_days, cfg.straggler_days)
    inside = F.coalesce(F.col("observed_at").between(F.lit(since), F.lit(end)), F.lit(False))
    outside = fetched.agg(F.count_if(~inside)).first()[0]
    return sync_window(store, fetched.filter(inside), since, end) | {"outside": outside}


def sync_rows(store: Store, fetched: DataFrame, revisions: bool = False) -> dict[str, int]:
    """Upsert rows of any dates."""
    return _merge(store, fetched, dry_run=False, revisions=revisions)


def sync_revisions(store: Store, rows: DataFrame) -> None:
    """As :func:`sync_rows` with ``revisions``, for unique rows that are read from files and when nobody asks for the counts.

    The changed rows go straight into their layer.
    """
    files = store.ensure_raw().raw_files()
    batch = schemas.conform(rows, schemas.RAW_OBSERVATIONS).withColumn("year", F.year("observed_at"))
    version = files.version()
    if version.parts or version.layers:
        written = newer_revisions(store.raw().filter(touching(batch, sinks.LAYOUT)), batch)
    else:
        written = batch.select("*", F.lit("new").alias("action"), F.lit(None).cast("double").alias("old_value"))
    generation = files.write(written, sinks.save_layer(sinks.RAW_ORDER))
    if files.holds_rows(generation):
        files.lay_over(generation, schemas.OBSERVATION_KEY)
    else:
        files.discard(generation)


def compact_raw(store: Store) -> int:
    """Fold the layers of past upserts into the folders they touch; returns the number of those folders.

    The rows stay the same.  Until the new folders are complete, readers see the old ones.
    """
    return store.raw_files().fold(_RAW_LAYER, sinks.save_layer(sinks.RAW_ORDER))


_RAW_LAYER = layers.with_partitions(schemas.RAW_OBSERVATIONS, sinks.LAYOUT)


def _merge(
    store: Store, fetched: DataFrame, dry_run: bool, revisions: bool = False
) -> dict[str, int]:
    files = store.ensure_raw().raw_files()
    asked, decided = (f"{shared_dir(store.spark)}/{name}-{uuid4().hex}" for name in ("fetched", "decided"))
    try:
        # both are read several times, and are of the size of the batch
        schemas.conform(fetched, schemas.RAW_OBSERVATIONS).withColumn("year", F.year("observed_at")).write.parquet(asked)
        batch = store.spark.read.schema(_RAW_LAYER).parquet(asked)
        existing = store.raw().filter(touching(batch, sinks.LAYOUT))
        merged = upserted_rows(existing, batch, revisions).withColumn("year", F.year("observed_at"))
        merged.write.parquet(decided)
        rows = store.spark.read.schema(merged.schema).parquet(decided)
        counts = rows.agg(*upsert_counts(), F.count_if("written").alias("written")).first().asDict()
        if counts.pop("written") and not dry_run:
            # the folders of a layer keep what was done to each row, for those who build on the raw rows
            rows = rows.filter("written").drop("newly_approved", "written")
            files.lay_over(files.write(rows, sinks.save_layer(sinks.RAW_ORDER)), schemas.OBSERVATION_KEY)
        return counts
    finally:
        remove(store.spark, asked)
        remove(store.spark, decided)
