"""Staging quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.operators.keyed import duplicates

GP_KEY = ["norad_id", "epoch", "source_group"]


def invalid_rows(stg_gp: DataFrame) -> DataFrame:
    """Rows per group with a missing part of the business key."""
    broken = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in GP_KEY))
    return stg_gp.where(broken).groupBy("source_group").agg(F.count("*").alias("invalid_rows"))


def duplicate_rows(stg_gp: DataFrame) -> DataFrame:
    return duplicates(stg_gp, GP_KEY)
