"""Joins with a side of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table (an id or two) that are broadcast: 16 to 32 MB. More of them are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if it has few rows, else as it is. Counts the rows, so pass a cheap table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
