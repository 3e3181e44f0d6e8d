"""Skyline: the rows no other row beats in both of two measures, or in all of any number of measures."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orbitlake.operators.numbering import PLACE, before_each_place, place_in_order
from orbitlake.workspace import write_through

GRID_CELLS = 1024  # at most, whatever the number of measures: bounds what is planned on the driver and broadcast


def skyline(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of ``df`` not dominated in (``first`` max, ``second`` max).

    Stated as an anti join this compares all pairs. Instead: per distinct ``first`` only the largest
    ``second`` can survive, and it does iff it exceeds the largest ``second`` of every greater ``first``,
    which is a running maximum in descending order of ``first``. The order is cut into range partitions;
    a partition needs only the maximum of the partitions before it, and rows at or under that maximum
    drop out before the running maximum is taken.

    A NULL measure compares with nothing: such rows neither dominate nor are dominated, and stay.
    ``df`` is read twice; pass a written table when it is expensive.
    """
    complete = F.col(first).isNotNull() & F.col(second).isNotNull()
    best = df.where(complete).groupBy(F.col(first).alias("_first")).agg(F.max(second).alias("_second"))
    placed = place_in_order(best, [F.col("_first").desc()], "skyline")
    carried = before_each_place(placed, F.max("_second"), F.max, F.lit(None))
    ahead = placed.join(F.broadcast(carried), PLACE).where(
        F.col("_carried").isNull() | (F.col("_second") > F.col("_carried"))
    )
    greater = Window.partitionBy(PLACE).orderBy(F.col("_first").desc()).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("_second").over(greater)
    survivors = (
        ahead.withColumn("_top", top)
        .where(F.col("_top").isNull() | (F.col("_second") > F.col("_top")))
        .select("_first", "_second")
    )
    matches = (F.col(first) == F.col("_first")) & (F.col(second) == F.col("_second"))
    undominated = df.join(survivors, matches, "left_semi")
    return undominated.unionByName(df.where(~complete))


def skyline_of(df: DataFrame, *measures: str) -> DataFrame:
    """Rows of ``df`` that no row equals or exceeds in all ``measures`` and exceeds in one.

    The distinct points are laid on a grid cut at the quantiles of every measure. A point in a cell whose coordinates
    are all greater beats all points of a cell, so such cells go without a look at their points; the grid is laid
    anew over what stays for as long as that halves it. A point left can only be beaten from cells at or above its own
    that reach it in every measure, and looks for one point there that does: a semi join on the cell, so no pair is
    put out, and adaptive execution splits the points that look into a full cell. The work of that join grows with the
    square of what no cell rules out, which is near the skyline itself.

    A row with a NULL measure neither dominates nor is dominated, and stays. Equal rows stay or go together. NaN is
    the greatest value. Measures are numbers, dates or timestamps. ``df`` is read twice; pass a written table when it
    is expensive.
    """
    if not measures:
        raise ValueError("a skyline needs a measure")
    complete = reduce(and_, (F.col(m).isNotNull() for m in measures))
    names = [f"_m{i}" for i in range(len(measures))]
    found = df.where(complete).select(*(F.col(m).alias(n) for m, n in zip(measures, names)))
    best = found.groupBy(*names[:-1]).agg(F.max(names[-1]).alias(names[-1])).where(F.col(names[-1]).isNotNull())
    points = write_through(best, "skyline-points")
    while True:
        placed, cells, live, total = _grid(points, names)
        placed = placed.where(F.col("_cell").isin([c._cell for c in live]))
        if 2 * sum(c._points for c in live) > total or not live:
            break
        points = write_through(placed.select(*names), "skyline-points")
    placed = write_through(placed, "skyline-cells")
    survivors = placed.select(*names).join(_beaten(placed, live, cells, names), names, "left_anti")
    equal = reduce(and_, (df[m] == survivors[n] for m, n in zip(measures, names)))
    return df.join(survivors, equal, "left_semi").unionByName(df.where(~complete))


def _grid(points: DataFrame, names: list[str]) -> tuple[DataFrame, dict[int, tuple], list[Row], int]:
    """Points with their cell, coordinates by cell, the cells no other beats as a whole, and the number of points."""
    slices = max(2, int(GRID_CELLS ** (1 / len(names)) + 1e-9))
    fractions = [i / slices for i in range(1, slices)]
    found = points.agg(*(F.percentile_approx(n, fractions, 100 * slices).alias(n) for n in names)).first()
    cuts = [sorted(set(found[n] or [])) for n in names]

    def coordinate(name: str, at: list) -> Column:
        return reduce(Column.__add__, ((F.col(name) > F.lit(c)).cast("bigint") for c in at), F.lit(0).cast("bigint"))

    cell = reduce(lambda c, place: c * slices + place, (coordinate(n, at) for n, at in zip(names, cuts)))
    placed = points.withColumn("_cell", cell)
    tops = (F.max(n).alias(n) for n in names)
    rows = placed.groupBy("_cell").agg(F.count("*").alias("_points"), *tops).collect()  # at most GRID_CELLS
    digits = [slices**i for i in reversed(range(len(names)))]
    cells = {r._cell: tuple(r._cell // d % slices for d in digits) for r in rows}
    at = np.array(list(cells.values())).reshape(len(rows), len(names))
    live = [r for r in rows if not (at > np.array(cells[r._cell])).all(axis=1).any()]
    return placed, cells, live, sum(r._points for r in rows)


def _beaten(placed: DataFrame, live: list[Row], cells: dict[int, tuple], names: list[str]) -> DataFrame:
    """Points of the live cells that some other point beats."""
    at = np.array([cells[r._cell] for r in live]).reshape(len(live), len(names))
    above = [
        (r._cell, other._cell, *(other[n] for n in names))
        for r in live
        for other in (live[i] for i in np.flatnonzero((at >= np.array(cells[r._cell])).all(axis=1)))
    ]
    tops = [StructField(f"_top{n}", placed.schema[n].dataType) for n in names]
    links = StructType([StructField("_cell", LongType()), StructField("_look", LongType()), *tops])
    reach = F.broadcast(placed.sparkSession.createDataFrame(above, links))  # pairs of the cells: bounded by the grid
    looking = (
        placed.join(reach, "_cell")
        .where(reduce(and_, (F.col(n) <= F.col(f"_top{n}") for n in names)))
        .select(*names, "_look")
    )
    there = placed.select(F.col("_cell").alias("_look"), *(F.col(n).alias(f"_by{n}") for n in names))
    at_least = reduce(and_, (F.col(f"_by{n}") >= F.col(n) for n in names))
    more = reduce(or_, (F.col(f"_by{n}") > F.col(n) for n in names))
    same_cell = looking["_look"] == there["_look"]
    return looking.join(there, same_cell & at_least & more, "left_semi").select(*names).distinct()
