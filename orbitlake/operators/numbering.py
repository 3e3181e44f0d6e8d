"""Row numbers over a whole table without moving it into one task.

``row_number()`` over a window without partitions sends every row to a single task. Here the rows are
range-partitioned on the full order, numbered inside each partition, and shifted by the sizes of the
partitions before. The range bounds come from sampling, so the placed rows are written once and both
passes read that copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake.workspace import write_through

PLACE, POSITION = "_place", "_position"
_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def place_in_order(df: DataFrame, order_by: list[Column], label: str) -> DataFrame:
    """``df`` with the range partition (``_place``) and the position inside it (``_position``) of every row.

    ``order_by`` should end in a unique key: ties then stay reproducible, and a value shared by very many
    rows is spread over several partitions.
    """
    row_id = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(POSITION, row_id)
        .withColumn(PLACE, F.shiftright(POSITION, _POSITION_BITS).cast("int"))
        .withColumn(POSITION, F.col(POSITION).bitwiseAND((1 << _POSITION_BITS) - 1))
    )
    return write_through(placed, label)


def before_each_place(placed: DataFrame, summary: Column, carry, initial) -> DataFrame:
    """Per range partition, ``carry`` (sum, max) of ``summary`` over all partitions before it.

    One row per partition, so the window and the broadcast that follows are bounded by the number of
    partitions, not by the data.
    """
    per_place = placed.groupBy(PLACE).agg(summary.alias("_summary"))
    earlier = Window.orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    return per_place.select(PLACE, F.coalesce(carry("_summary").over(earlier), initial).alias("_carried"))


def global_row_number(
    df: DataFrame,
    order_by: list[Column],
    column: str = "row_number",
    after: Column | None = None,
) -> DataFrame:
    """Number all rows 1, 2, 3, … in the given order, continuing after the value ``after``."""
    placed = place_in_order(df, order_by, "numbering")
    starts = before_each_place(placed, F.count("*"), F.sum, F.lit(0))
    number = F.col("_carried") + F.col(POSITION) + 1
    if after is not None:
        number = number + after
    return placed.join(F.broadcast(starts), PLACE).select(*df.columns, number.cast("bigint").alias(column))


def global_dense_rank(df: DataFrame, measure: str, column: str = "rank") -> DataFrame:
    """Dense rank of every row by ``measure`` descending (NULLs last).

    Only the distinct values are numbered; the rows then look their rank up.
    """
    values = df.select(F.col(measure).alias("_value")).distinct()
    ranked = global_row_number(values, [F.col("_value").desc_nulls_last()], column)
    return df.join(ranked, F.col(measure).eqNullSafe(F.col("_value")), "left").drop("_value")


def top_dense_rank(df: DataFrame, measure: str, ties: list[str], n: int, column: str = "rank") -> DataFrame:
    """The first ``n`` rows by dense rank of ``measure`` descending.

    A row's dense rank depends only on the rows above it, so the ranks of the first ``n`` rows follow from
    those rows alone: a distributed top-n first, the window over ``n`` rows after.
    """
    order = [F.col(measure).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties)]
    top = df.orderBy(*order).limit(n)
    rank = F.dense_rank().over(Window.orderBy(F.col(measure).desc_nulls_last()))
    return top.withColumn(column, rank.cast("bigint")).orderBy(column, *(F.col(c).asc_nulls_last() for c in ties))


def systematic_sample(df: DataFrame, order_by: list[Column], target: int = K.SAMPLE_TARGET) -> DataFrame:
    """Every k-th row in order, k = floor(n / min(n, target)) and at least 1; the first row is always kept."""
    numbered = global_row_number(df, order_by, "_row")
    total = numbered.agg(F.count("*").alias("n"))
    step = total.select(
        F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(1), F.least(F.col("n"), F.lit(target))))).cast("bigint")
    ).scalar()
    return numbered.where((F.col("_row") - 1) % step == 0).withColumnRenamed("_row", "position")
