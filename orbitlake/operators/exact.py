"""Sums and means of doubles that do not depend on the order of additions, so that they can decide comparisons.

A value counts in whole units of 10⁻¹⁵. The units are added as two integers, their upper and lower digits, which takes
two plain sums per row and cannot round; a decimal holds the total of a group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10**15  # per one
_LOWER = 10**8  # units of the lower part: 9 · 10¹⁰ rows of a group fit in a 64-bit sum


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of ``value`` in units, decimal(38,0); NULLs are left out, of nothing else it is NULL. Values
    have to be below 9000, and their last digit below a unit is rounded, each by itself.
    """
    units = F.floor(value * float(UNITS) + 0.5)
    lower = F.pmod(units, F.lit(_LOWER))
    upper = F.floor((units - lower) / _LOWER + 0.5)  # a whole number; the division of integers is one of doubles
    whole = F.sum(upper).cast("decimal(28,0)") * F.lit(_LOWER).cast("decimal(9,0)")
    return (whole + F.sum(lower).cast("decimal(20,0)")).cast("decimal(38,0)")


def exact_mean(units: Column, count: Column) -> Column:
    """The mean as a double, from a sum of units. Equal means come out equal, whatever their counts; others differ if
    they are a double's precision apart. NULL for a count of 0."""
    return (units / F.nullif(count, F.lit(0))).cast("double") / float(UNITS)
