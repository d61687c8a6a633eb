"""Landed JSON pages and hourly feeds as typed rows."""

from __future__ import annotations

from datetime import datetime
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import classify
from tidemark.functions.regions import region_of
from tidemark.operators.upsert import one_per_key, unique_observations

# Parameter code -> metric name.
METRIC_BY_CODE = {"00060": "streamflow", "00065": "gage_height", "00010": "water_temperature"}

# Accepted names of the hourly time and value columns, best first.
HOURLY_TIME = ("Interval Start", "Time", "Interval End", "timestamp")
HOURLY_VALUE = ("NG: WAT", "Hydro")

# A page that is not the expected JSON is an error; it must not vanish.
STRICT = {"mode": "FAILFAST"}


def read_pages(spark: SparkSession, path: str, page_schema) -> DataFrame:
    """One row per feature of the landed page files (one JSON document per file).

    A malformed page fails the job.
    """
    pages = spark.read.schema(page_schema).options(multiLine=True, **STRICT).json(path)
    return features(pages)


def parse_pages(df: DataFrame, column: str, page_schema) -> DataFrame:
    """One row per feature of pages held as JSON text in a column; null is no page.

    A malformed page fails the job.
    """
    page = F.from_json(column, page_schema, STRICT)
    return features(df.select(page.alias("_page")).select("_page.*"))


def features(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("features").alias("f")).select("f.*")


def metric_of(code: Column, names: dict[str, str] = METRIC_BY_CODE) -> Column:
    """Metric of a parameter code; an unknown code stands for itself."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(literal, code), code)


def _coordinate(i: int) -> Column:
    """Coordinate of a feature, [longitude, latitude]; null when absent."""
    return F.get("geometry.coordinates", F.lit(i)).cast("double")


def observations(
    feature_rows: DataFrame, collected_at: datetime | Column, source: str = "usgs_daily",
    names: dict[str, str] = METRIC_BY_CODE,
) -> DataFrame:
    """Observation features flattened to the raw schema, one row per key.

    ``raw_payload`` is the text of the properties as landed, undeclared fields included.
    """
    return unique_observations(observation_rows(feature_rows, collected_at, source, names))


def observation_rows(
    feature_rows: DataFrame, collected_at: datetime | Column, source: str = "usgs_daily",
    names: dict[str, str] = METRIC_BY_CODE, kept: tuple[str, ...] = (),
) -> DataFrame:
    """Observation features flattened to the raw schema, with all their repeats; columns ``kept`` stay beside."""
    when = collected_at if isinstance(collected_at, Column) else F.lit(collected_at)
    p = "_parsed."
    parsed = F.from_json("properties", schemas.OBSERVATION_PROPERTIES)
    return feature_rows.withColumn("_parsed", parsed).select(
        F.lit(source).alias("source"),
        F.col(p + "monitoring_location_id").alias("entity_id"),
        F.try_to_date(p + "time", "yyyy-MM-dd").alias("observed_at"),
        when.cast("timestamp").alias("collected_at"),
        metric_of(F.col(p + "parameter_code"), names).alias("metric"),
        F.col(p + "parameter_code").alias("parameter_code"),
        F.col(p + "value").try_cast("double").alias("value"),
        F.col(p + "unit_of_measure").alias("unit"),
        _coordinate(1).alias("latitude"),
        _coordinate(0).alias("longitude"),
        F.col(p + "approval_status").alias("approval_status"),
        F.col(p + "qualifier").alias("qualifier"),
        F.col("properties").alias("raw_payload"),
        *kept,
    )


def judged_rows(
    pages: DataFrame, collected_at: datetime | Column, source: str = "usgs_daily",
    names: dict[str, str] = METRIC_BY_CODE,
) -> DataFrame:
    """Observation rows of landed pages (page, path) and, among them, what can't be loaded: nothing is lost, and
    nothing stops the load.

    ``reason`` is null for an observation.  Pages that are not the expected JSON, and features without an entity, a
    parameter or a date have one, beside their ``path`` and their text as ``content``.  A null page is none.  Rows may
    repeat a key.  A page is parsed once for both.
    """
    expected = T.StructType([*schemas.OBSERVATION_PAGE.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("page", expected, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    fault = (
        F.when(F.col("_page").isNull() | F.col("_page._corrupt").isNotNull(), "malformed page")
        .when(F.col("_page.features").isNull(), "no features")
    )
    read = pages.filter(F.col("page").isNotNull()).withColumn("_page", parsed).withColumn("_fault", fault)
    # a faulty page goes on as one feature without content
    nothing = F.array(F.lit(None).cast(schemas.OBSERVATION_FEATURE))
    faulty = F.col("_fault").isNotNull()
    carried = [c for c in pages.columns if c != "page"]
    feature = read.select(
        *carried, "_fault", F.when(faulty, F.col("page")).alias("_text"),
        F.explode(F.when(faulty, nothing).otherwise(F.col("_page.features"))).alias("_feature"))
    rows = observation_rows(
        feature.select(*carried, "_fault", "_text", "_feature.*"), collected_at, source, names,
        kept=("path", "_fault", "_text"))
    reason = (
        F.when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(F.col("entity_id").isNull(), "no entity")
        .when(F.col("parameter_code").isNull(), "no parameter")
        .when(F.col("observed_at").isNull(), "no date")
    )
    rejected = F.col("reason").isNotNull()
    text = F.when(F.col("_fault").isNotNull(), F.col("_text")).otherwise(F.col("raw_payload"))
    return rows.withColumn("reason", reason).select(
        *[c for c in rows.columns if c not in ("path", "_fault", "_text")],
        "reason", F.when(rejected, F.col("path")).alias("path"), F.when(rejected, text).alias("content"))


def sorted_pages(
    pages: DataFrame, collected_at: datetime | Column, source: str = "usgs_daily",
    names: dict[str, str] = METRIC_BY_CODE,
) -> tuple[DataFrame, DataFrame]:
    """(observation rows, rejects) of landed pages, see :func:`judged_rows`."""
    return split_judged(judged_rows(pages, collected_at, source, names))


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    fine = F.col("reason").isNull()
    return judged.filter(fine).drop("reason", "path", "content"), judged.filter(~fine).select("path", "reason", "content")


def station_rows(feature_rows: DataFrame) -> DataFrame:
    """Station-metadata features flattened, one row per id."""
    p = "properties."
    rows = feature_rows.select(
        F.coalesce(p + "id", "id").alias("entity_id"),
        F.col(p + "monitoring_location_name").alias("station_name"),
        F.coalesce(p + "state_name", F.lit("")).alias("state"),
        F.col(p + "state_code").alias("state_code"),
        _coordinate(1).alias("latitude"),
        _coordinate(0).alias("longitude"),
        *[F.col(p + c).alias(c) for c in
          ("hydrologic_unit_code", "site_type", "agency_code")],
        F.col(p + "drainage_area").try_cast("double").alias("drainage_area"),
    ).filter(F.col("entity_id").isNotNull())
    return one_per_key(rows, ["entity_id"], F.struct(*rows.columns[1:]))


def record_starts(periods: DataFrame) -> DataFrame:
    """First year of the series that ends last, per station."""
    end = F.coalesce("end_utc", F.lit(""))
    return (
        periods.filter(F.col("begin_utc") != "")
        .groupBy(F.col("monitoring_location_id").alias("entity_id"))
        .agg(F.max_by("begin_utc", F.struct(end, F.col("begin_utc"))).alias("_begin"))
        .select("entity_id", F.substring("_begin", 1, 4).try_cast("int").alias("first_year_of_record"))
    )


def stations(
    feature_rows: DataFrame, periods: DataFrame, curated: DataFrame | None = None
) -> DataFrame:
    """The station dimension: metadata, record start and region.

    A non-empty region in ``curated`` (entity_id, region) takes precedence.
    """
    rows = station_rows(feature_rows).join(record_starts(periods), "entity_id", "left")
    if curated is None:
        chosen = None
    else:
        rows = rows.join(
            curated.select("entity_id", F.col("region").alias("_curated")), "entity_id", "left"
        )
        chosen = F.col("_curated")
    out = rows.withColumns({
        "region": region_of(F.col("state"), F.col("state_code"), chosen),
        "earliest_verified_year": classify.verified_year(F.col("first_year_of_record")),
    })
    return schemas.conform(out, schemas.STATIONS)


def first_present(df: DataFrame, candidates: tuple[str, ...]) -> Column | None:
    """The first candidate column the frame has."""
    for name in candidates:
        if name in df.columns:
            return F.col(f"`{name}`")
    return None


def hourly_series(df: DataFrame) -> DataFrame:
    """(ts, value) of an hourly feed whose column names vary."""
    ts, value = first_present(df, HOURLY_TIME), first_present(df, HOURLY_VALUE)
    if ts is None:
        stamps = [n for n, kind in df.dtypes if kind.startswith("timestamp")]
        ts = F.col(f"`{stamps[0]}`") if stamps else None
    if ts is None or value is None:
        raise ValueError(f"no time or value column among {df.columns}")
    return df.select(ts.cast("timestamp").alias("ts"), value.cast("double").alias("value"))
