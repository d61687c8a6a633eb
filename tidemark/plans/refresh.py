"""Baselines and daily layer kept up to date from what upserts changed, without reading everything again."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scores
from tidemark.operators.baseline import SLOT, baselines_of, day_of_year_stats, merged_stats, state_schema
from tidemark.operators.daily import SERIES, daily_entity_metrics, daily_stats, newest_observed, observed
from tidemark.plans.build import Store
from tidemark.plans.quality import raw_profile
from tidemark.settings import Settings
from tidemark.sources import layers, sinks

_CHANGED = T.StructType([
    *layers.with_partitions(schemas.RAW_OBSERVATIONS, sinks.LAYOUT).fields,
    T.StructField("action", T.StringType()), T.StructField("old_value", T.DoubleType())])


def _save_state(df: DataFrame, target: str) -> None:
    (
        df.hint("rebalance", "metric").sortWithinPartitions("metric", "entity_id", "day_of_year")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("metric").parquet(target)
    )


_save_baselines = sinks.save_table(["entity_id", "metric", "day_of_year"])
_save_daily = sinks.save_layer(sinks.DAILY_ORDER)


def _among(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``; nulls are equal."""
    renamed = keys.select(*[F.col(c).alias(f"_of_{c}") for c in names])
    return df.join(renamed, reduce(and_, [df[c].eqNullSafe(renamed[f"_of_{c}"]) for c in names]), "left_semi")


def _window(cfg: Settings) -> str:
    return f"{cfg.baseline_start} {cfg.baseline_end} {cfg.half_window}"


def rebuild(store: Store, cfg: Settings = Settings(), today: date | None = None) -> dict[str, int]:
    """State, baselines and daily layer from all raw rows."""
    raw, files = store.raw(), store.raw_files()
    seen = files.version().last
    state = store.state_files()
    state.replace(state.write(day_of_year_stats(raw, cfg), _save_state), raw=seen, window=_window(cfg))
    known = store.baseline_files()
    known.replace(known.write(baselines_of(store.baseline_state(cfg), cfg), _save_baselines), raw=seen)
    end = today or newest_observed(raw)
    daily = store.daily_files()
    rows = daily_entity_metrics(daily_stats(raw), store.baselines(), end)
    daily.replace(daily.write(rows, _save_daily), raw=seen, today=str(end))
    return {"series": -1, "slots": -1}


def refresh(store: Store, cfg: Settings = Settings(), today: date | None = None) -> dict[str, int]:
    """Bring state, baselines and daily layer up to the raw rows; returns how many series and slots were touched.

    New values are added to the moments of their slot.  A slot with a revised value is computed anew from the raw rows
    of its series, so nothing is ever subtracted.  Baselines and daily rows are then made for the touched series
    alone and laid over the stored ones; series without changes only get the days that have passed since.  Each layer notes
    up to which generation of the raw rows it has come, in the same flip that shows its rows, so a refresh that was
    broken off is simply run again.  Everything is rebuilt (counts of -1) where the raw rows have been rewritten
    since, with other settings, if the newest day has gone back or if a series has lost its last value.
    """
    files, state, daily = store.raw_files(), store.state_files(), store.daily_files()
    versions = [x.version() for x in (state, store.baseline_files(), daily)]
    if any(v is None or "raw" not in v.notes for v in versions) or versions[0].notes["window"] != _window(cfg):
        return rebuild(store, cfg, today)
    seen, old_end = files.version().last, date.fromisoformat(versions[2].notes["today"])
    came = [v.notes["raw"] for v in versions]
    changes = files.layers_after(min(came), _CHANGED)
    if changes is None:
        return rebuild(store, cfg, today)
    raw = store.raw()
    # whoever has a value on the old newest day or later decides how far the calendar goes
    newest = newest_observed(raw.filter(F.col("year") >= old_end.year))
    end = today or newest
    if end is None or end < old_end:
        return rebuild(store, cfg, today)
    # a row may have changed more than once
    valued = changes.filter(F.col("observed_at").isNotNull() & (F.col("value").isNotNull() | F.col("old_value").isNotNull()))
    series = valued.select(*SERIES).distinct()
    lost = valued.filter(F.col("value").isNull()).select(*SERIES).distinct()
    for kept in (raw, raw.filter(F.col("observed_at").between(F.lit(cfg.baseline_start), F.lit(cfg.baseline_end)))):
        if not _among(lost, observed(kept).select(*SERIES), SERIES).count() == lost.count():
            return rebuild(store, cfg, today)  # a series without any value left has no rows to lay over its old ones
    counts = {"series": series.count(), "slots": 0}
    if counts["series"]:
        if came[0] < seen:
            counts["slots"] = _refresh_state(store, valued.filter(F.col("gen") > came[0]), raw, cfg, seen)
        if came[1] < seen:
            touched = baselines_of(_among(store.baseline_state(cfg), series, SERIES), cfg)
            known = store.baseline_files()
            known.lay_over(known.write(touched, _save_baselines), SERIES, raw=seen)
    if end > old_end:
        # before the touched series, whose rows then replace these
        quiet = _passed_days(store.daily(), old_end, end)
        daily.lay_over(daily.write(quiet, _save_daily), [], today=str(end))
    if counts["series"] and came[2] < seen:
        own = _among(store.baselines(), series, SERIES)
        rows = daily_entity_metrics(daily_stats(_among(raw, series, SERIES)), own, end)
        daily.lay_over(daily.write(rows, _save_daily), SERIES, raw=seen)
    for layer in (state, store.baseline_files(), daily):
        if layer.version().notes["raw"] < seen:
            layer.note(raw=seen)
    return counts


def _refresh_state(store: Store, changes: DataFrame, raw: DataFrame, cfg: Settings, seen: int) -> int:
    inside = changes.filter(F.col("observed_at").between(F.lit(cfg.baseline_start), F.lit(cfg.baseline_end)))
    slots = inside.withColumn("day_of_year", F.dayofyear("observed_at")).groupBy(*SLOT).agg(
        F.max(F.col("old_value").isNotNull()).alias("revised"))
    touched = slots.count()
    if not touched:
        return 0
    revised, added = slots.filter("revised").select(*SLOT), slots.filter("not revised").select(*SLOT)
    fresh = _among(day_of_year_stats(inside, cfg), added, SLOT)
    state = store.baseline_state(cfg)
    grown = merged_stats(_among(state, added, SLOT), fresh, cfg)
    of_series = _among(raw, revised.select(*SERIES).distinct(), SERIES)
    anew = _among(day_of_year_stats(of_series, cfg), revised, SLOT)
    # a slot that has lost all its values stays as a row without any
    rest = [c for c in state_schema(cfg).fieldNames() if c not in SLOT]
    renamed = anew.select(*[F.col(c).alias(f"_of_{c}") for c in SLOT], *rest)
    same = reduce(and_, [revised[c].eqNullSafe(renamed[f"_of_{c}"]) for c in SLOT])
    anew = revised.join(renamed, same, "left").select(*SLOT, F.coalesce("n", F.lit(0)).alias("n"), *rest[1:])
    files = store.state_files()
    generation = files.write(grown.unionByName(anew), _save_state)
    files.lay_over(generation, SLOT, raw=seen)
    return touched


def _passed_days(daily: DataFrame, old_end: date, end: date) -> DataFrame:
    """The days behind the old end as days without observations, for every series."""
    known = daily.filter((F.col("year") == old_end.year) & (F.col("observed_at") == F.lit(old_end))).select(*SERIES)
    days = F.sequence(F.date_add(F.lit(old_end), 1), F.lit(end))
    rows = known.withColumn("observed_at", F.explode(days)).withColumns({
        "observation_count": F.lit(0), "completeness_score": scores.completeness(F.lit(0)), "year": F.year("observed_at")})
    missing = {f.name: F.lit(None) for f in schemas.DAILY_ENTITY_METRICS.fields if f.name not in rows.columns}
    return schemas.conform(rows.withColumns(missing), schemas.DAILY_ENTITY_METRICS)


def compact(store: Store, cfg: Settings = Settings()) -> None:
    """Fold the layers over state, baselines and daily rows into their folders."""
    store.state_files().fold(state_schema(cfg), _save_state)
    store.baseline_files().fold(schemas.SEASONAL_BASELINES, _save_baselines)
    schema = layers.with_partitions(schemas.DAILY_ENTITY_METRICS, sinks.LAYOUT)
    store.daily_files().fold(schema, _save_daily)


def refresh_profile(store: Store) -> None:
    """Keep the profile that the checks start from up to the raw rows.

    What a batch changed is added as a few rows per series, never more than the batch has; the first time, or after the
    raw rows were rewritten, all of them are read once.
    """
    files, raw = store.profile_files(), store.raw_files()
    seen, version = raw.version().last, files.version()
    changes = raw.layers_after(version.notes["raw"], _CHANGED) if version else None
    save = sinks.save_table(["entity_id", "metric"])
    if changes is None:
        files.replace(files.write(raw_profile(store.raw()), save), raw=seen)
    elif version.notes["raw"] < seen:
        new = F.col("action") == "new"
        was_missing = F.when(new, 0).otherwise(F.col("old_value").isNull().cast("int"))
        added = changes.groupBy(*SERIES).agg(
            F.count_if(new).alias("n"), F.count_if(new & F.col("observed_at").isNull()).alias("no_date"),
            F.sum(F.col("value").isNull().cast("int") - was_missing).alias("no_value"), F.max("observed_at").alias("newest"))
        files.lay_over(files.write(added, save), [], raw=seen)
