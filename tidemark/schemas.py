"""Table schemas.  Readers always apply one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

RAW_OBSERVATIONS = _struct(
    source=S, entity_id=S, observed_at=T.DateType(), collected_at=T.TimestampType(),
    metric=S, parameter_code=S, value=D, unit=S, latitude=D, longitude=D,
    approval_status=S, qualifier=T.ArrayType(S), raw_payload=S,
)
OBSERVATION_KEY = ["entity_id", "parameter_code", "observed_at"]

SEASONAL_BASELINES = _struct(
    entity_id=S, metric=S, day_of_year=I, mu=D, sigma=D, n_years=I,
)

DAILY_ENTITY_METRICS = _struct(
    entity_id=S, metric=S, observed_at=T.DateType(), observation_count=I,
    minimum=D, maximum=D, average=D, daily_change=D, rise_rate_3d=D,
    flow_percentile=D, anomaly_score=D, completeness_score=D, record_proximity=D,
    year=I,
)

RISER = _struct(entity_id=S, station_name=S, rise_rate_3d=D, value=D)

DAILY_CATEGORY_METRICS = _struct(
    date=T.DateType(), region=S, metric=S, entity_count=I, event_count=I,
    average_anomaly=D, extreme_entity_count=I, fastest_risers=T.ArrayType(RISER), year=I,
)

STATIONS = _struct(
    entity_id=S, station_name=S, state=S, region=S, latitude=D, longitude=D,
    hydrologic_unit_code=S, site_type=S, agency_code=S, drainage_area=D,
    first_year_of_record=I, earliest_verified_year=I,
)

MONTHLY_GENERATION = _struct(location=S, period=S, generation_thousand_mwh=D)

ALIGNED_PAIRS = _struct(
    entity_id=S, period=S, mean_flow_cfs=D, generation_thousand_mwh=D, confidence=S,
)

CORRELATION_RAW = _struct(
    entity_id=S, eia_location=S, confidence=S, n_months=I,
    pearson_raw=D, pearson_raw_p=D, spearman_raw=D, spearman_raw_p=D,
    pearson_anom=D, pearson_anom_p=D, spearman_anom=D, spearman_anom_p=D,
    best_lag=I, best_lag_corr=D,
)

CORRELATION_FINAL = _struct(
    entity_id=S, eia_location=S, confidence=S, n_months=I,
    spearman_anom=D, spearman_anom_p=D, pearson_anom=D, best_lag=I,
    tier=S, decoupled=B, significant=B,
)

# What the checks need to know of the raw rows, per series.
RAW_PROFILE = _struct(
    entity_id=S, metric=S, n=T.LongType(), no_date=T.LongType(), no_value=T.LongType(), newest=T.DateType(),
)

# What a load of pages left out.
REJECTED = _struct(batch_id=T.LongType(), path=S, reason=S, content=S)

# One page of landed observation features.
_POINT = _struct(coordinates=T.ArrayType(D))
OBSERVATION_PROPERTIES = _struct(
    monitoring_location_id=S, time=S, parameter_code=S, value=S, unit_of_measure=S,
    approval_status=S, qualifier=T.ArrayType(S),
)
# properties stay JSON text, so that fields nobody declared are kept
OBSERVATION_FEATURE = _struct(properties=S, geometry=_POINT)
OBSERVATION_PAGE = _struct(features=T.ArrayType(OBSERVATION_FEATURE))

# One page of landed station-metadata features.
STATION_FEATURE = _struct(
    id=S,
    properties=_struct(
        id=S, monitoring_location_name=S, state_name=S, state_code=S,
        hydrologic_unit_code=S, site_type=S, agency_code=S, drainage_area=S,
    ),
    geometry=_POINT,
)
STATION_PAGE = _struct(features=T.ArrayType(STATION_FEATURE))

# Period-of-record listing: one row per series of a station.
SERIES_PERIODS = _struct(monitoring_location_id=S, begin_utc=S, end_utc=S)


def columns(schema: T.StructType) -> list[str]:
    return schema.fieldNames()


def conform(df, schema: T.StructType):
    """Select the schema's columns, in order, cast to its types."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
