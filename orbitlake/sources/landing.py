"""The landing area: files ``…/{time}_{source}{extension}`` as downloaded."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.operators.keyed import latest_per_key, missing_from


def feed_table(spark: SparkSession, feeds=K.FEEDS) -> DataFrame:
    """The configured feeds as a small local relation; a feed configured twice counts once."""
    rows = [F.struct(F.lit(n).alias("source_name"), F.lit(k).alias("kind"), F.lit(u).alias("source_uri")) for n, k, u in dict.fromkeys(feeds)]
    return spark.sql("SELECT 1").select(F.inline(F.array(*rows)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_of(path: Column) -> Column:
    """Source from the file name, else from the archive folder ``source_name=…`` the file lies in."""
    named = F.regexp_extract(file_name(path), r"^[0-9]{8}T[0-9]{9}Z_(.*?)(\.[^.]*)?$", 1)
    filed = F.regexp_extract(path, r"/source_name=([^/]*)/", 1)
    return F.when(named != "", named).otherwise(filed)


def downloaded_at(path: Column, modified: Column) -> Column:
    """Download time from the file name, else the file's own time."""
    stamp = F.regexp_extract(file_name(path), r"^([0-9]{8}T[0-9]{9}Z)_", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(K.RAW_FILE_TIME_FORMAT)), modified)


def with_feed(files: DataFrame, feeds: DataFrame) -> DataFrame:
    """Attach kind and address of the feed each file came from; files of unknown feeds keep a NULL kind."""
    named = files.withColumns(
        {
            "source_name": source_of(F.col("path")),
            "downloaded_at": downloaded_at(F.col("path"), F.col("modified")),
        }
    )
    return named.join(feeds, "source_name", "left")


def read_snapshots(spark: SparkSession, landing: str, feeds: DataFrame | None = None) -> DataFrame:
    """All files of a landing folder, one row each, with binary ``content``. Small files share tasks."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(landing)
        .select("path", "content", F.col("modificationTime").alias("modified"))
    )
    return with_feed(files, feed_table(spark) if feeds is None else feeds).drop("modified")


def _decoded(path: Column) -> Column:
    """A path as ``binaryFile`` spells it, from the spelling of ``_metadata``, where it is an encoded address."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _day(path: Column, as_of: dt.date) -> Column:
    """The day of a file by its name; files without a time in it count as of ``as_of``."""
    return F.to_date(downloaded_at(path, F.lit(as_of).cast("timestamp")))


def newest_days(
    spark: SparkSession, landing: str, as_of: dt.date, feeds: DataFrame | None = None, unknown: bool = False
) -> DataFrame:
    """(source_name, kind, day): the newest day up to ``as_of`` of every source, whose files a run of that day stages, so
    that a feed without a new file keeps its last one. Files without a time in their name count as of the day.
    ``unknown``: also those of feeds that are not configured, with a NULL kind. Lists files without reading them.
    """
    return _newest_days(_all_files(spark, landing), feed_table(spark) if feeds is None else feeds, as_of, unknown)


def _all_files(spark: SparkSession, landing: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing)


def _newest_days(files: DataFrame, feeds: DataFrame, as_of: dt.date, unknown: bool) -> DataFrame:
    dated = files.select(source_of(F.col("path")).alias("source_name"), _day(F.col("path"), as_of).alias("day"))
    newest = dated.where(F.col("day") <= F.lit(as_of)).groupBy("source_name").agg(F.max("day").alias("day"))
    known = newest.join(feeds.select("source_name", "kind").distinct(), "source_name", "left")
    return (known if unknown else known.where(F.col("kind").isNotNull())).select("source_name", "kind", "day")


def read_day(
    spark: SparkSession, landing: str, as_of: dt.date, feeds: DataFrame | None = None, unknown: bool = False
) -> dict[str | None, DataFrame]:
    """The day's snapshots by kind, with binary content; ``unknown`` as in ``newest_days``. The folder is listed once, and a
    scan picks its files from that listing by their names, so the driver fetches a row a source and none a file."""
    table = feed_table(spark) if feeds is None else feeds
    files = _all_files(spark, landing)
    own: dict[str | None, list[tuple[str, dt.date]]] = {kind: [] for kind in (K.GP, K.REGISTRY, K.LAUNCHES)}
    for row in _newest_days(files, table, as_of, unknown).collect():
        own.setdefault(row.kind, []).append((row.source_name, row.day))

    def read(days: list[tuple[str, dt.date]]) -> DataFrame:
        path = _decoded(F.col("_metadata.file_path"))
        staged = F.concat_ws("/", _day(path, as_of).cast("string"), source_of(path)).isin([f"{day}/{source}" for source, day in days])
        return files.where(staged).select("path", "content", F.col("modificationTime").alias("modified"))

    return {kind: with_feed(read(days), table).drop("modified") for kind, days in own.items()}


def as_text(snapshots: DataFrame) -> DataFrame:
    return schemas.conform(snapshots, schemas.RAW_SNAPSHOT)


def is_workbook() -> Column:
    """Zip container: the signature decides, not the file's extension."""
    return F.coalesce(F.hex(F.substring("content", 1, 4)) == "504B0304", F.lit(False))


def of_kind(snapshots: DataFrame, kind: str) -> DataFrame:
    return snapshots.where(F.col("kind") == kind)


def latest_snapshots(spark: SparkSession, landing: str) -> DataFrame:
    """Newest non-empty file per source and extension; lists files without reading them."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(landing)
        .select("path", "length", F.col("modificationTime").alias("modified"))
        .where(F.col("length") > 0)
    )
    keyed = files.withColumns(
        {
            "source_name": source_of(F.col("path")),
            "extension": F.regexp_extract(file_name(F.col("path")), r"(\.[^.]*)$", 1),
        }
    ).where(F.col("source_name") != "")
    return latest_per_key(keyed, ["source_name", "extension"], [F.col("modified").desc(), F.col("path").desc()])


def write_archive(snapshots: DataFrame, path: str) -> None:
    """Keep raw snapshots by source and day; a snapshot of the same source, time and path is kept once."""
    archived = snapshots.withColumn("ingest_date", F.to_date("downloaded_at"))
    parts = ["source_name", "ingest_date"]
    archived.where(F.lit(False)).write.mode("ignore").partitionBy(*parts).parquet(path)
    kept = snapshots.sparkSession.read.schema(archived.schema).parquet(path)
    archived = missing_from(archived, kept, ["source_name", "downloaded_at", "path"])
    archived.write.mode("append").partitionBy("source_name", "ingest_date").parquet(path)
