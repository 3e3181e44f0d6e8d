"""Operators over keys: latest row, append what is missing, upsert, shares of the maximum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The first row per key in the given order; end the order with a unique column to make it reproducible.

    Spark applies the limit of one row per key before the shuffle as well, so a key holding very many rows
    sends one row per task. (An aggregate over structs gives the same rows in about twice the time.)
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_position", position).where(F.col("_position") == 1).drop("_position")


def missing_from(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key does not occur in ``existing``; a NULL key part never matches."""
    return candidates.join(existing.select(*keys), keys, "left_anti")


def append_missing(target: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The target after an append that repeats nothing."""
    return target.unionByName(missing_from(candidates, target, keys))


def on_same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k] == right[k] for k in keys))


def upsert(target: DataFrame, source: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Merge on ``key``: matched rows take the ``update`` columns of the source, unmatched source rows are
    inserted whole, rows only in the target stay. A key that the source repeats fails the query.
    """
    repeated = (F.count(key).over(Window.partitionBy(key)) > 1) & source[key].isNotNull()
    hit = F.when(repeated, F.raise_error(F.concat(F.lit(f"{key} repeated in the source: "), source[key].cast("string"))).cast("boolean"))
    incoming = source.select(hit.otherwise(F.lit(True)).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in target.columns))
    merged = target.withColumn("_kept", F.lit(True)).join(
        incoming, target[key] == incoming[f"_new_{key}"], "full_outer"
    )

    def merged_column(name: str) -> Column:
        # inserted rows come whole from the source; matched rows only in the updated columns
        takes_new = F.col("_hit").isNotNull() if name in update else F.col("_kept").isNull()
        return F.when(takes_new, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    return merged.select(*(merged_column(c) for c in target.columns))


def percent_of_max(df: DataFrame, measure: str, floor: float, column: str = "percent") -> DataFrame:
    """``measure`` as a percentage of its maximum, held within [floor, 100]; 0 where the maximum is not positive.

    The maximum is a scalar subquery, so no row leaves its partition.
    """
    top = df.agg(F.coalesce(F.max(measure), F.lit(0)).cast("double")).scalar()
    share = F.coalesce(F.col(measure), F.lit(0)).cast("double") / top * 100.0
    held = F.greatest(F.lit(float(floor)), F.least(F.lit(100.0), share))
    return df.withColumn(column, F.when(top <= 0, F.lit(0.0)).otherwise(held))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of the key columns that occurs, once (NULLs count as equal)."""
    return df.select(*keys).distinct()


def duplicates(df: DataFrame, keys: list[str], column: str = "duplicate_count") -> DataFrame:
    """Keys that occur more than once, with their counts (NULLs count as equal)."""
    return df.groupBy(*keys).agg(F.count("*").alias(column)).where(F.col(column) > 1)


def with_days(df: DataFrame, first: Column, last: Column, column: str = "day") -> DataFrame:
    """Every row once per calendar day from ``first`` to ``last``: a generator, not a cross join."""
    return df.withColumn(column, F.explode(F.sequence(first, last, F.expr("interval 1 day"))))
