"""Deduplication, latest-wins merge and change-detecting upsert."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.schemas import OBSERVATION_KEY

COMPARED = ["value", "approval_status", "qualifier", "unit", "latitude", "longitude"]
REFRESHED = ["value", "unit", "latitude", "longitude",
             "approval_status", "qualifier", "raw_payload", "collected_at"]


def one_per_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate rather than a row number: copies of one key are reduced inside
    each task before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


#: Orders the revisions of an observation: newest first, draws by content.
REVISION = ["collected_at", "raw_payload", "value"]


def newest_revisions(df: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """One row per observation key, and per value of the columns ``apart``; the newest ``collected_at`` is kept.

    The greatest row that begins with what orders the revisions, so that a payload is sorted and shuffled once
    and not a second time as its own order.
    """
    key = [*OBSERVATION_KEY, *apart]
    row = F.struct(*REVISION, *[c for c in df.columns if c not in key and c not in REVISION])
    return (
        df.groupBy(*key).agg(F.max(row).alias("_row"))
        .select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def unique_observations(df: DataFrame) -> DataFrame:
    """One row per observation key; the greatest payload is kept."""
    return one_per_key(df, OBSERVATION_KEY, F.struct("raw_payload", "collected_at", "value"))


def latest_wins(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both, newest ``collected_at`` per key; the new row wins a draw."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        schemas.conform(new, existing.schema).withColumn("_new", F.lit(1))
    )
    order = F.struct("collected_at", "_new", "raw_payload")
    return one_per_key(both, OBSERVATION_KEY, order).drop("_new")


def same_key(left: DataFrame, right: DataFrame, key: list[str] = OBSERVATION_KEY) -> Column:
    """Equality of all key columns, in which nulls are equal; Spark still joins by hash or sort."""
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in key])


def upsert(existing: DataFrame, fetched: DataFrame, revisions: bool = False) -> DataFrame:
    """Merge fetched rows into existing ones, with the action taken on each row.

    ``action`` is untouched (not fetched), unchanged (fetched, same content, keeps
    its old ``collected_at``), updated or new; ``newly_approved`` marks updates
    that turned a known other status into Approved.  One full outer join on the
    key, in which nulls are equal; ``fetched`` holds a key at most once, see :func:`unique_observations`.

    With ``revisions``, fetched rows may be older than those that exist: the newest
    revision stays in all its columns, so the outcome doesn't depend on the order in
    which files arrive.
    """
    return _merged(existing, fetched, revisions, "full_outer").drop("written", "old_value")


def upserted_rows(existing: DataFrame, fetched: DataFrame, revisions: bool = False) -> DataFrame:
    """As :func:`upsert`, but only the fetched rows, with ``written``: whether the stored row changes, and ``old_value``.

    Existing rows are reduced to the fetched keys before anything is merged.
    """
    keys = fetched.select(*[F.col(c).alias(c) for c in OBSERVATION_KEY])
    return _merged(existing.join(keys, same_key(existing, keys), "left_semi"), fetched, revisions, "right_outer")


def newer_revisions(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """The rows that :func:`upserted_rows` with ``revisions`` marks as written, with their ``action`` and ``old_value``.

    Those are the fetched ones as they are, so of the existing rows only the compared columns meet them.
    """
    old = {c: f"_old_{c}" for c in dict.fromkeys([*OBSERVATION_KEY, *REVISION, *COMPARED])}
    seen = schemas.conform(existing, schemas.RAW_OBSERVATIONS).select(
        *[F.col(c).alias(name) for c, name in old.items()], F.lit(True).alias("_old"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(old[c])) for c in OBSERVATION_KEY])
    newer = F.struct(*REVISION) > F.struct(*[old[c] for c in REVISION])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(old[c])) for c in COMPARED])
    action = F.when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return (
        fetched.join(seen, on, "left").filter(F.col("_old").isNull() | newer)
        .select(*fetched.columns, action.alias("action"), F.col(old["value"]).alias("old_value"))
    )


def _merged(existing: DataFrame, fetched: DataFrame, revisions: bool, how: str) -> DataFrame:
    names = schemas.columns(schemas.RAW_OBSERVATIONS)
    old = schemas.conform(existing, schemas.RAW_OBSERVATIONS).select(
        *[F.col(c).alias(f"_old_{c}") for c in OBSERVATION_KEY], F.struct(*names).alias("old")
    )
    new = schemas.conform(fetched, schemas.RAW_OBSERVATIONS).select(
        *[F.col(c).alias(f"_new_{c}") for c in OBSERVATION_KEY], F.struct(*names).alias("new")
    )
    on = reduce(and_, [old[f"_old_{c}"].eqNullSafe(new[f"_new_{c}"]) for c in OBSERVATION_KEY])
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    newer = F.struct(*[f"new.{c}" for c in REVISION]) > F.struct(*[f"old.{c}" for c in REVISION])
    action = (
        F.when(F.col("new").isNull(), "untouched")
        .when(F.col("old").isNull(), "new")
        .when(same | ~newer if revisions else same, "unchanged")
        .otherwise("updated")
    )
    approved = (
        (F.col("action") == "updated")
        & (F.col("old.approval_status") != "Approved")
        & (F.col("new.approval_status") == "Approved")
    )
    # a revision may be newer without any change of content
    taken = F.col("new").isNotNull() & (F.col("old").isNull() | newer)
    written = taken if revisions else F.col("action").isin("new", "updated")

    def resolved(c: str) -> Column:
        before, after = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in OBSERVATION_KEY:
            return F.coalesce(before, after).alias(c)
        if revisions:
            return F.when(taken, after).otherwise(before).alias(c)
        if c in REFRESHED:
            return F.when(F.col("action").isin("new", "updated"), after).otherwise(before).alias(c)
        return F.when(F.col("action") == "new", after).otherwise(before).alias(c)

    return (
        old.join(new, on, how)
        .withColumn("action", action)
        .withColumn("newly_approved", F.coalesce(approved, F.lit(False)))
        .select(*[resolved(c) for c in names], "action", "newly_approved", written.alias("written"), F.col("old.value").alias("old_value"))
    )


def upsert_counts() -> list[Column]:
    """Aggregates over an upsert result; usable in ``agg`` and in ``observe``."""
    return [
        *[F.count_if(F.col("action") == a).alias(a) for a in ("new", "updated", "unchanged")],
        F.count_if("newly_approved").alias("provisional_to_approved"),
    ]


def fetch_window(
    today: date, last_day: date | None, revision_days: int = 30, straggler_days: int = 2
) -> tuple[date, date]:
    """Inclusive dates to fetch again: recent revisions and days after the last one."""
    newest = last_day or today
    return min(today - timedelta(days=revision_days), newest - timedelta(days=straggler_days)), today


def only_in(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks; both are reduced before they meet."""
    names = [key] if isinstance(key, str) else key
    present = right.select(*names).distinct()
    return left.select(*names).distinct().join(present, names, "left_anti")
