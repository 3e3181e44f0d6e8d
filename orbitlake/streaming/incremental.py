"""Incremental ingest and append: only files and rows that are new since the last run are processed.

Progress lives in the checkpoint folder. Both sinks can repeat a batch without repeating rows: the ingest
overwrites the batch's own folder, the append skips keys that are present. Late data are accepted whenever
they arrive, so there is no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orbitlake import schemas
from orbitlake.plans import pipeline
from orbitlake.plans.warehouse import Warehouse
from orbitlake.sources import landing, rows
from orbitlake.workspace import write_through

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def snapshot_stream(spark: SparkSession, folder: str, feeds: DataFrame | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New landing files as raw snapshots with binary content, one row per file."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.load(folder).select("path", "content", F.col("modificationTime").alias("modified"))
    return landing.with_feed(files, landing.feed_table(spark) if feeds is None else feeds)


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    kind: str,
    staging_path: str,
    checkpoint: str,
    feeds: DataFrame | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Parse all new files of one kind into ``staging_path`` (and ``…_rejects``) as a whole run would, then stop."""
    schema = schemas.TABLES[next(name for name, own in pipeline.KINDS.items() if own == kind)]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        parsed = write_through(pipeline.read_kind(landing.of_kind(batch, kind), kind), "streamed")
        rows.good(parsed, schema).write.mode("overwrite").parquet(f"{staging_path}/batch={batch_id}")
        rows.rejected(parsed).write.mode("overwrite").parquet(f"{staging_path}_rejects/batch={batch_id}")

    stream = snapshot_stream(spark, folder, feeds, files_per_batch)
    return (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_new_observations(
    warehouse: Warehouse,
    staged_path: str,
    dim_space_object: DataFrame,
    dim_source: DataFrame,
    stg_registry: DataFrame,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the observations of newly staged element sets to the facts, then stop."""

    def append_batch(batch: DataFrame, batch_id: int) -> None:
        staged = batch.persist()
        pipeline.append_observations(warehouse, staged, dim_space_object, dim_source, stg_registry)
        staged.unpersist()

    reader = warehouse.spark.readStream.schema(schemas.STG_GP).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(staged_path)
        .writeStream.foreachBatch(append_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
