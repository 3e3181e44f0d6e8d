"""Orbital element sets as JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake import schemas
from orbitlake.functions.lenient import is_blank, lenient_double, lenient_int, lenient_timestamp, without_mark
from orbitlake.functions.naming import source_group
from orbitlake.sources.rows import NOTHING, computed_once, split
from orbitlake.sources.variants import text

# Field names of the feed
NAME, CATALOGUE_ID, EPOCH = "OBJECT_NAME", "NORAD_CAT_ID", "EPOCH"
MEASURES = {"INCLINATION": "inclination_deg", "ECCENTRICITY": "eccentricity", "MEAN_MOTION": "mean_motion"}

# Only the named fields are parsed. Numbers may arrive as numbers or as text, so their text is enough; names and
# epochs must be text, and a variant remembers whether they were.
_TYPES = {NAME: "variant", EPOCH: "variant", CATALOGUE_ID: "string", **dict.fromkeys(MEASURES, "string")}
_ITEMS = "array<struct<" + ", ".join(f"{field}: {kind}" for field, kind in _TYPES.items()) + ">>"


def looks_like_json(content: Column) -> Column:
    """The first visible character opens an array or an object."""
    return F.coalesce(content.rlike(r"^\s*[\[{]"), F.lit(False))


def is_array(content: Column) -> Column:
    return F.coalesce(content.rlike(r"^\s*\["), F.lit(False))


def read_gp_json(snapshots: DataFrame) -> DataFrame:
    """One row per element set or problem.

    The six fields are required. Names and epochs must be JSON strings; numbers may be numbers or numeric strings.
    A file that is refused is kept whole in ``detail``.
    """
    content = without_mark(F.col("content"))
    gate = F.when(~looks_like_json(content), F.lit("not json")).when(~is_array(content), F.lit("not an array"))
    files = computed_once(
        snapshots,
        ["path", "source_name", "downloaded_at"],
        {
            "_gate": gate,
            "_items": F.when(gate.isNull(), F.from_json(content, _ITEMS)),
            "_preview": F.when(gate.isNotNull(), content),
            "source_group": source_group(F.col("source_uri"), F.col("source_name")),
        },
    )
    items = F.col("_items")
    problem = F.coalesce("_gate", F.when(items.isNull(), F.lit("malformed json")), F.when(F.size(items) == 0, F.lit(NOTHING)))
    rows = files.select(
        "path", "source_name", "downloaded_at", "source_group", "_preview", problem.alias("_problem"),
        F.explode_outer(items).alias("_item"),
    )
    item = F.col("_item")
    fields = {
        "object_name": text(item[NAME]),
        "norad_id": lenient_int(item[CATALOGUE_ID]).cast("bigint"),
        "epoch": lenient_timestamp(text(item[EPOCH])),
        **{column: lenient_double(item[field]) for field, column in MEASURES.items()},
    }
    parsed = computed_once(
        rows,
        ["path", "source_name", "source_group", "_problem", "_preview", F.col("downloaded_at").alias("imported_at"), "_item"],
        fields,
    )
    incomplete = is_blank(F.col("object_name"))
    for column in list(fields)[1:]:
        incomplete = incomplete | F.col(column).isNull()
    reason = F.coalesce("_problem", F.when(incomplete, F.lit("missing required field")))
    return computed_once(
        parsed,
        ["path", "source_name", *schemas.STG_GP.names],
        {"reason": reason, "detail": F.when(reason.isNotNull(), F.coalesce("_preview", F.to_json(item)))},
    )


def parse_gp_json(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(read_gp_json(snapshots), schemas.STG_GP)
