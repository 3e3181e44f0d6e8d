"""JSON values as Spark variants, which remember whether a value was a string or something else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    """The value only if it is a JSON string."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def array_length(value: Column) -> Column:
    """Length of a JSON array, NULL for anything else."""
    is_array = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(is_array, F.size(F.try_variant_get(value, "$", "array<variant>")))
