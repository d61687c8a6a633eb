"""Incremental load of landed files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.operators.upsert import newest_revisions
from tidemark.plans.build import Store, compact_raw, sync_revisions
from tidemark.session import remove, shared_dir
from tidemark.sources import sinks
from tidemark.sources.landed import METRIC_BY_CODE, judged_rows, split_judged


def landed_observations(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of raw-schema Parquet files as they land."""
    reader = spark.readStream.schema(schemas.RAW_OBSERVATIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def landed_pages(
    spark: SparkSession, path: str, files_per_batch: int | None = None, page_per_line: bool = False
) -> DataFrame:
    """Stream of JSON pages as they land: text, path of the file and when it landed.

    The text is not parsed here, so no page can stop the stream.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path, wholetext=not page_per_line).select(
        F.col("value").alias("page"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("landed_at"))


def upsert_stream(
    stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True, compact_after: int = 16
) -> StreamingQuery:
    """Upsert every micro-batch into the raw layer.

    The table is the state, so late rows need no watermark.  The newest revision of an
    observation stays, within a batch and against the table, so neither batch
    boundaries nor the order of files nor a replay change the outcome.  A batch writes what it changes; after
    ``compact_after`` of them their rows are folded into the folders.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            with _staged(store, newest_revisions(schemas.conform(batch, schemas.RAW_OBSERVATIONS))) as rows:
                sync_revisions(store, rows)
            _compact(store, compact_after)

    return _started(stream, load, checkpoint, available_now)


def upsert_page_stream(
    stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True, compact_after: int = 16,
    collected_at: Column | None = None, source: str = "usgs_daily", names: dict[str, str] = METRIC_BY_CODE,
) -> StreamingQuery:
    """Parse and upsert every micro-batch of pages (see :func:`landed_pages`); put aside what can't be loaded.

    Rejects go to ``store.rejected()`` with the number of their batch; a replayed batch replaces its own.  They
    are written before the rows, so a page is in one of both once its batch is done.  ``collected_at`` is the
    time the page landed unless given.
    """
    when = F.col("landed_at") if collected_at is None else collected_at

    def load(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # parsed once: each reject is a key of its own, so that one shuffle makes the rows unique and keeps all rejects
        number = F.when(F.col("reason").isNotNull(), F.monotonically_increasing_id())
        judged = judged_rows(batch, when, source, names).withColumn("_reject", number)
        with _staged(store, newest_revisions(judged, apart=("_reject",)).drop("_reject")) as both:
            rows, rejects = split_judged(both)
            rejects = rejects.select(F.lit(batch_id).cast("long").alias("batch_id"), "path", "reason", "content")
            if not rejects.isEmpty():
                files = store.rejected_files()
                if files.version() is None:
                    sinks.write_table(rejects.limit(0), store.path("rejected"))
                files.lay_over(files.write(rejects, sinks.save_table()), ["batch_id"])
            sync_revisions(store, rows)
        _compact(store, compact_after)

    return _started(stream, load, checkpoint, available_now)


@contextmanager
def _staged(store: Store, rows: DataFrame) -> Iterator[DataFrame]:
    """The frame written below the shared folder, as it is read several times; of the size of the batch."""
    path = f"{shared_dir(store.spark)}/staged-{uuid4().hex}"
    try:
        rows.write.parquet(path)
        yield store.spark.read.schema(rows.schema).parquet(path)
    finally:
        remove(store.spark, path)


def _compact(store: Store, after: int) -> None:
    version = store.raw_files().version()
    if version is not None and len(version.layers) >= after:
        compact_raw(store)
    version = store.rejected_files().version()
    if version is not None and len(version.layers) >= after:
        store.rejected_files().fold(schemas.REJECTED, sinks.save_table())


def _started(
    stream: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
