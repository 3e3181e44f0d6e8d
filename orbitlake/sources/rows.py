"""Shared shape of all parsers: one pass over the files that yields good and rejected rows together.

A row that could not be used carries a ``reason``; rows that stand for nothing (an empty list) carry ``NOTHING``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbitlake import schemas

NOTHING = ""


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``columns``, each evaluated once per row.

    Spark pushes filters below projections by repeating the projected expressions in the filter, which doubles
    the cost of parsing. It does not push them below a generator, so the columns come out of one.
    """
    fields = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*keep, F.inline_outer(F.array(fields)))


def good(rows: DataFrame, schema: StructType) -> DataFrame:
    return schemas.conform(rows.where(F.col("reason").isNull()), schema)


def rejected(rows: DataFrame) -> DataFrame:
    bad = rows.where(F.col("reason").isNotNull() & (F.col("reason") != NOTHING))
    return bad.select("path", "source_name", "reason", "detail")


def split(rows: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    return good(rows, schema), rejected(rows)
