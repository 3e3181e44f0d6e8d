"""Staging files: sorted CSV with a header and fixed time formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbitlake import constants as K
from orbitlake import schemas

_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "timestampFormat": K.STAGING_TIMESTAMP_FORMAT,
    "dateFormat": K.STAGING_DATE_FORMAT,
}

# The order rows are written in
ORDER = {
    "stg_celestrak_objects": ["norad_id", "epoch", "source_group"],
    "stg_ucs_satellites": ["norad_id", "satellite_name"],
    "stg_launch_events": ["launch_date", "launch_name"],
    "satellite_tle_stage": ["NORAD_ID"],
}


def write_staging(df: DataFrame, folder: str, table: str, run_date: dt.date, delimiter: str = ",") -> str:
    """Write one table's staging files under ``folder/run_date/table``, globally sorted across the part files.

    Returns the path. An empty table writes a header only.
    """
    path = f"{folder.rstrip('/')}/{run_date:%Y-%m-%d}/{table}"
    order = [F.col(c).asc_nulls_first() for c in ORDER[table]]
    df.orderBy(*order).write.options(**_OPTIONS, sep=delimiter).mode("overwrite").csv(path)
    return path


def read_staging(spark: SparkSession, path: str, schema: StructType, delimiter: str = ",") -> DataFrame:
    """Typed staging rows: trimmed, blank is NULL, a value that does not fit its type fails the load."""
    return (
        spark.read.schema(schema)
        .options(**_OPTIONS, sep=delimiter, mode="FAILFAST", nullValue="", enforceSchema=False)
        .options(ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True)
        .csv(path)
    )


def read_staging_tables(spark: SparkSession, folder: str, run_date: dt.date) -> dict[str, DataFrame]:
    """The three staging tables of a run."""
    base = f"{folder.rstrip('/')}/{run_date:%Y-%m-%d}"
    names = ["stg_celestrak_objects", "stg_ucs_satellites", "stg_launch_events"]
    return {n: read_staging(spark, f"{base}/{n}", schemas.TABLES[n]) for n in names}
