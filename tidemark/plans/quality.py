"""Data-quality checks as one table: check, subject, observed, status."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.upsert import only_in
from tidemark.session import held
from tidemark.settings import Settings


def _status(good: Column, soft: bool = False) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), "ok").otherwise("warn" if soft else "fail")


def _unpivot(one_row: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One aggregated row turned into one row per check."""
    entries = F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"),
                 value.cast("double").alias("observed"), status.alias("status"))
        for check, subject, value, status in checks
    ])
    return one_row.select(F.inline(entries))


def row_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """A layer without rows fails."""
    parts = [
        _unpivot(df.agg(F.count("*").alias("n")),
                 [("row_count", name, F.col("n"), _status(F.col("n") > 0))])
        for name, df in layers.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def raw_profile(raw: DataFrame) -> DataFrame:
    """Rows, missing dates, missing values and newest day per entity and metric."""
    return raw.groupBy("entity_id", "metric").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("observed_at").isNull()).alias("no_date"),
        F.count_if(F.col("value").isNull()).alias("no_value"),
        F.max("observed_at").alias("newest"),
    )


def raw_checks(profile: DataFrame, today: date, cfg: Settings = Settings()) -> DataFrame:
    """Row count, identity nulls, share of null values and freshness."""
    one = profile.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.when(F.col("entity_id").isNull(), F.col("n")).otherwise(0)).alias("no_entity"),
        F.sum(F.when(F.col("metric").isNull(), F.col("n")).otherwise(0)).alias("no_metric"),
        F.sum("no_date").alias("no_date"),
        F.try_divide(F.sum("no_value"), F.sum("n")).alias("null_share"),
        F.max("newest").alias("newest"),
    )
    age = F.datediff(F.lit(today), F.col("newest"))
    identity = {"entity_id": "no_entity", "observed_at": "no_date", "metric": "no_metric"}
    return _unpivot(one, [
        ("row_count", "raw_observations", F.col("n"), _status(F.col("n") > 0)),
        *[("identity_nulls", c, F.col(n), _status(F.col(n) == 0)) for c, n in identity.items()],
        ("value_null_share", "value", F.col("null_share"),
         _status(F.col("null_share") <= cfg.null_value_tolerance)),
        ("days_old", "observed_at", age, _status(age <= cfg.stale_after_days, soft=True)),
    ])


def missing_members(
    present: DataFrame, expected: DataFrame, key: str, soft: bool = False
) -> DataFrame:
    """How many expected members are not present, and a row with the name of each."""
    lacking = only_in(expected, present, key)
    counted = _unpivot(
        lacking.agg(F.count("*").alias("n")),
        [(f"missing_{key}", key, F.col("n"), _status(F.col("n") == 0, soft))])
    named = lacking.select(
        F.lit(f"lacks_{key}").alias("check"), F.col(key).alias("subject"),
        F.lit(0.0).alias("observed"), _status(F.lit(False), soft).alias("status"))
    return counted.unionByName(named)


def expected_metrics(spark, cfg: Settings) -> DataFrame:
    names = F.array(*[F.lit(m) for m in cfg.expected_metrics])
    return spark.range(1).select(F.explode(names).alias("metric"))


def health_report(
    raw: DataFrame, daily: DataFrame, category: DataFrame, stations: DataFrame, today: date,
    cfg: Settings = Settings(),
) -> DataFrame:
    """All checks.  Runs a job: the raw layer is read once, into a profile."""
    return report_of(held(raw_profile(raw)), daily, category, stations, today, cfg)


def report_of(
    profile: DataFrame, daily: DataFrame, category: DataFrame, stations: DataFrame, today: date,
    cfg: Settings = Settings(),
) -> DataFrame:
    """All checks from the profile of the raw rows, fresh or stored; no raw row is read."""
    parts = [
        row_counts({"daily_entity_metrics": daily, "daily_category_metrics": category}),
        raw_checks(profile, today, cfg),
        missing_members(profile, expected_metrics(profile.sparkSession, cfg), "metric"),
        missing_members(profile, stations, "entity_id", soft=True),
    ]
    return reduce(DataFrame.unionByName, parts)
