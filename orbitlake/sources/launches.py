"""Launches as JSON: an array, or an object whose ``results`` is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.functions.lenient import lenient_timestamp, without_mark
from orbitlake.functions.naming import fallback_launch_id
from orbitlake.sources.rows import NOTHING, computed_once, split
from orbitlake.sources.variants import array_length, text

# Only these fields are parsed; the leaves stay variants, which remember whether they were text. A value of
# another shape on the way to a leaf (say, text where an object belongs) makes that field NULL, nothing else.
_LAUNCH = (
    "struct<id: variant, name: variant, net: variant, window_start: variant,"
    " launch_service_provider: struct<name: variant>,"
    " rocket: struct<configuration: struct<full_name: variant, name: variant>,"
    " spacecraft_stage: struct<payloads: variant>>,"
    " status: struct<name: variant>,"
    " pad: struct<location: struct<country_code: variant>, country_code: variant>>"
)


def _problem(content: Column, opens: Column, items: Column) -> Column:
    """Why a file yields no launches; the document is looked at again only when it yields none."""
    return (
        F.when(items.isNotNull(), F.when(F.size(items) == 0, F.lit(NOTHING)))
        .when((opens == "{") & F.try_parse_json(content).isNotNull(), F.lit("no launch array"))
        .otherwise(F.lit("malformed json"))
    )


def read_launches(snapshots: DataFrame) -> DataFrame:
    """One row per launch (one page per file) or problem. A file that is refused is kept whole in ``detail``."""
    content = F.col("content")
    snapshots = computed_once(snapshots, ["path", "source_name", "downloaded_at"], {"content": without_mark(content)})
    opens = F.regexp_extract(content, r"^\s*([\[{])", 1)
    page = F.from_json(content, f"struct<results: array<{_LAUNCH}>>")["results"]
    found = computed_once(
        snapshots,
        ["path", "source_name", "downloaded_at", "content"],
        {
            "_items": F.when(opens == "[", F.from_json(content, f"array<{_LAUNCH}>")).when(opens == "{", page),
            "_opens": opens,
        },
    )
    items = F.col("_items")
    files = computed_once(
        found,
        ["path", "source_name", "downloaded_at", "_items"],
        {
            "_problem": _problem(content, F.col("_opens"), items),
            "_preview": F.when(items.isNull(), content),
        },
    )
    rows = files.select(
        "path", "source_name", "downloaded_at", "_preview", "_problem", F.explode_outer(items).alias("_item")
    )
    item = F.col("_item")
    rocket, pad = item["rocket"], item["pad"]
    fields = {
        "_id": text(item["id"]),
        "launch_name": F.coalesce(text(item["name"]), F.lit(K.UNKNOWN)),
        "launch_date": F.coalesce(lenient_timestamp(text(item["net"])), lenient_timestamp(text(item["window_start"]))),
        "launch_provider": text(item["launch_service_provider"]["name"]),
        "rocket_name": F.coalesce(
            text(rocket["configuration"]["full_name"]), text(rocket["configuration"]["name"])
        ),
        "launch_country": F.coalesce(text(pad["location"]["country_code"]), text(pad["country_code"])),
        "launch_status": text(item["status"]["name"]),
        "payload_count": array_length(rocket["spacecraft_stage"]["payloads"]).cast("bigint"),
        "imported_at": F.col("downloaded_at"),
        "reason": F.coalesce("_problem", F.when(item.isNull(), F.lit("not an object"))),
    }
    parsed = computed_once(rows, ["path", "source_name", "_preview"], fields)
    own_or_derived = F.coalesce(
        "_id", fallback_launch_id(F.col("launch_name"), F.col("launch_date"), F.col("launch_provider"))
    )
    columns = parsed.withColumns({"launch_id": own_or_derived, "detail": F.col("_preview")})
    return columns.select("path", "source_name", *schemas.STG_LAUNCH.names, "reason", "detail")


def parse_launches(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(read_launches(snapshots), schemas.STG_LAUNCH)
