"""The corpus pipeline: each stage takes the documents its predecessor kept and returns those it keeps.

``run`` writes every stage as Parquet to the shared folder and reads it back as the next one's documents. All stages
but the last return the columns they were given, so further columns travel along; the last returns one row per piece
of a packed document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from orbitlake.llm.queries import table, toxicity_model
from orbitlake.llm.sizes import broadcast_if_small
from orbitlake.workspace import write_through

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes when its toxicity score reaches this.
TOXIC = 0.5


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is among ``ids``; rows without an id stay."""
    gone = write_through(ids.select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct(), "gone")
    gone = broadcast_if_small(gone)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; learned from the labelled documents that are not held out."""
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return _without(docs, scored.where(F.col("score") >= TOXIC))


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one of every group of similar lines left; those that lose all their lines go. ``n_chars``, where
    there is one, follows the text."""
    kept = line_dedup.dedup_lines(docs, drop_emptied=True)
    if "n_chars" not in docs.columns:
        return kept
    counted = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), counted).otherwise(F.col("n_chars")))


def drop_similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that of the least id."""
    found = jaccard_join.similar_documents(docs.select("doc_id", "text"))
    return _without(docs, found.where("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return _without(docs, decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its ids, sequence and place."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_similar_lines),
    ("jaccard_join", drop_similar_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, tokens and hashes have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
