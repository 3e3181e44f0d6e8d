"""Two-line element text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.functions import tle as T
from orbitlake.functions.lenient import lenient_double, lenient_int, trimmed, without_mark
from orbitlake.sources import landing, lines
from orbitlake.sources.rows import NOTHING, computed_once, rejected


def _framed(snapshots: DataFrame, pattern: str) -> DataFrame:
    found = computed_once(
        snapshots, ["path", "source_name", "downloaded_at"], {"_records": T.records(without_mark(F.col("content")), pattern)}
    )
    records = found.select(
        "path", "source_name", "downloaded_at", F.posexplode_outer("_records").alias("record_no", "_record")
    )
    parts = F.split(F.col("_record"), "\n")
    return computed_once(
        records,
        ["path", "source_name", "downloaded_at", "record_no"],
        {"name": trimmed(parts[0]), "line1": F.rtrim(parts[1]), "line2": F.rtrim(parts[2])},
    )


def framed_lines(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    """The records of text files as ``_framed`` finds them, without ever holding a file: read in splits, framed by line.

    A record is three lines in a row. Two records that overlap share the second one's name line, which is the first
    one's last: of such a chain, left to right, every other record stands. ``record_no`` is the number of the name line.
    """
    triples = lines.with_next(lines.read_lines(spark, paths), 2)
    likely = F.col("next_1").startswith("1 ") & F.col("next_2").startswith("2 ")
    whole = F.regexp_extract(F.concat_ws("\n", "line", "next_1", "next_2"), pattern, 0) != ""
    records = lines.alternate(triples.where(likely).where(whole), 2)
    return records.select(
        "path",
        landing.source_of(F.col("path")).alias("source_name"),
        landing.downloaded_at(F.col("path"), F.col("modified")).alias("downloaded_at"),
        F.col("line_no").alias("record_no"),
        trimmed(F.col("line")).alias("name"),
        F.rtrim("next_1").alias("line1"),
        F.rtrim("next_2").alias("line2"),
    )


def _field1(name: str) -> Column:
    return T.field(F.col("line1"), T.LINE_1_FIELDS[name])


def _field2(name: str) -> Column:
    return T.field(F.col("line2"), T.LINE_2_FIELDS[name])


def _read(framed: DataFrame, fields: dict[str, Column], numbers: list[str]) -> DataFrame:
    """One row per record; a number that is none makes the record a reject."""
    parsed = computed_once(framed, framed.columns, fields)
    malformed = F.lit(False)
    for n in numbers:
        malformed = malformed | F.col(n).isNull()
    reason = F.when(F.col("line1").isNull(), F.lit(NOTHING)).when(malformed, F.lit("malformed number"))
    detail = F.when(reason.isNotNull(), F.concat_ws("\n", "name", "line1", "line2"))
    return computed_once(parsed, parsed.columns, {"reason": reason, "detail": detail})


def parse_tle(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Element sets with orbit measures and epoch, and records with malformed numbers."""
    return _elements(_framed(snapshots, T.FULL_RECORD))


def parse_tle_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``parse_tle`` of text files, read in splits: a large file is many tasks."""
    return _elements(framed_lines(spark, paths, T.FULL_RECORD))


def _elements(framed: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = {
        "object_name": F.col("name"),
        "norad_id": lenient_int(_field1("norad_id")),
        "classification": _field1("classification"),
        "international_designator": F.trim(_field1("international_designator")),
        "epoch_year": lenient_int(_field1("epoch_year")),
        "epoch_day": lenient_double(_field1("epoch_day")),
        "inclination_deg": lenient_double(_field2("inclination")),
        "eccentricity": lenient_double(F.concat(F.lit("0."), _field2("eccentricity"))),
        "mean_motion": lenient_double(_field2("mean_motion")),
    }
    numbers = ["norad_id", "epoch_year", "epoch_day", "inclination_deg", "eccentricity", "mean_motion"]
    rows = _read(framed, fields, numbers)
    kept = rows.where(F.col("reason").isNull()).drop("reason", "detail", "name")
    return kept.withColumn("epoch", T.epoch(F.col("epoch_year"), F.col("epoch_day"))), rejected(rows)


def parse_tle_catalogue(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue variant: only the ids and the epoch numbers, the designator in parts, a short line 2 allowed."""
    return _catalogue(_framed(snapshots, T.CATALOGUE_RECORD))


def parse_tle_catalogue_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``parse_tle_catalogue`` of text files, read in splits."""
    return _catalogue(framed_lines(spark, paths, T.CATALOGUE_RECORD))


def _catalogue(framed: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = {
        "satellite_name": F.col("name"),
        "norad_id": lenient_int(_field1("norad_id")),
        "classification": _field1("classification"),
        "designator_year": lenient_int(_field1("designator_year")),
        "designator_launch_number": lenient_int(_field1("designator_launch_number")),
        "designator_piece": F.trim(_field1("designator_piece")),
        "epoch_year": lenient_int(_field1("epoch_year")),
        "epoch_day": lenient_double(_field1("epoch_day")),
    }
    numbers = ["norad_id", "designator_year", "designator_launch_number", "epoch_year", "epoch_day"]
    rows = _read(framed, fields, numbers)
    return rows.where(F.col("reason").isNull()).drop("reason", "detail", "name"), rejected(rows)


def tle_stage(good: DataFrame) -> DataFrame:
    """The nine staging columns of the full variant."""
    utc = F.concat(F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"), F.lit("Z"))
    return good.select(
        F.col("norad_id").alias("NORAD_ID"),
        F.col("object_name").alias("SATELLITE_NAME"),
        F.col("classification").alias("CLASSIFICATION"),
        F.col("international_designator").alias("INTERNATIONAL_DESIGNATOR"),
        F.col("epoch_year").alias("EPOCH_YEAR"),
        F.col("epoch_day").alias("EPOCH_DAY"),
        F.col("source_name").alias("SOURCE_NAME"),
        utc.alias("DOWNLOADED_AT_UTC"),
        F.col("path").alias("RAW_FILE_PATH"),
    )
