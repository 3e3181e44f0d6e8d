"""Table contracts as Spark DDL schemas; column order is part of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def table_schema(columns: str) -> StructType:
    """Schema from ``name type, name type, …`` (usable before a session exists)."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


STG_GP = table_schema(
    "object_name string, norad_id bigint, epoch timestamp, inclination_deg double, eccentricity double, "
    "mean_motion double, source_group string, imported_at timestamp"
)
STG_REGISTRY = table_schema(
    "norad_id bigint, satellite_name string, country string, operator_name string, purpose string, "
    "orbit_type string, operational_status string, launch_date date, imported_at timestamp"
)
STG_LAUNCH = table_schema(
    "launch_id string, launch_name string, launch_date timestamp, launch_provider string, rocket_name string, "
    "launch_country string, launch_status string, payload_count bigint, imported_at timestamp"
)
DIM_OPERATOR = table_schema("operator_id bigint, operator_name string, operator_type string, country string")
DIM_SPACE_OBJECT = table_schema(
    "object_id bigint, norad_id bigint, object_name string, object_type string, operational_status string, "
    "purpose string, launch_date date, operator_id bigint"
)
DIM_ORBIT_BAND = table_schema(
    "orbit_band_id bigint, orbit_class string, altitude_min_km double, altitude_max_km double, inclination_class string"
)
DIM_SOURCE = table_schema("source_id bigint, source_name string, source_type string, source_url string")
FACT_OBSERVATION = table_schema(
    "observation_id bigint, object_id bigint, orbit_band_id bigint, source_id bigint, observation_timestamp timestamp, "
    "altitude_km double, latitude double, longitude double, velocity_km_s double, inclination_deg double, "
    "object_count bigint, debris_risk_score double"
)
FACT_LAUNCH = table_schema(
    "launch_event_id bigint, launch_id string, source_id bigint, launch_timestamp timestamp, launch_name string, "
    "provider_name string, rocket_name string, launch_country string, launch_status string, launch_site string, "
    "payload_count bigint, success_count bigint"
)
STG_TLE = table_schema(
    "NORAD_ID int, SATELLITE_NAME string, CLASSIFICATION string, INTERNATIONAL_DESIGNATOR string, EPOCH_YEAR int, "
    "EPOCH_DAY double, SOURCE_NAME string, DOWNLOADED_AT_UTC string, RAW_FILE_PATH string"
)
RAW_SNAPSHOT = table_schema(
    "path string, content string, source_name string, source_uri string, kind string, downloaded_at timestamp"
)

TABLES = {
    "stg_celestrak_objects": STG_GP,
    "stg_ucs_satellites": STG_REGISTRY,
    "stg_launch_events": STG_LAUNCH,
    "dim_operator": DIM_OPERATOR,
    "dim_space_object": DIM_SPACE_OBJECT,
    "dim_orbit_band": DIM_ORBIT_BAND,
    "dim_source": DIM_SOURCE,
    "fact_object_position_observation": FACT_OBSERVATION,
    "fact_launch_event": FACT_LAUNCH,
}

# Longest text each warehouse column accepts.
MAX_LENGTHS = {
    "object_name": 512,
    "source_group": 128,
    "satellite_name": 512,
    "country": 256,
    "operator_name": 512,
    "purpose": 512,
    "orbit_type": 128,
    "operational_status": 128,
    "launch_id": 128,
    "launch_name": 512,
    "launch_provider": 512,
    "rocket_name": 512,
    "launch_country": 128,
    "launch_status": 128,
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the contract's columns in order, cast to the contract's types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def over_long(df: DataFrame) -> DataFrame:
    """Rows whose text would not fit the warehouse column, with the offending column names."""
    limited = [c for c in df.columns if c in MAX_LENGTHS]
    flags: list[Column] = [F.when(F.length(c) > MAX_LENGTHS[c], F.lit(c)) for c in limited]
    return df.withColumn("over_long", F.array_compact(F.array(*flags))).where(F.size("over_long") > 0)
