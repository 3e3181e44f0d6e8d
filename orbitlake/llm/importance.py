"""Quality by importance resampling.

Texts are bags of word unigrams and bigrams hashed into a fixed number of cells. Two generative models count cells:
that of the target (documents labelled good) and that of all raw documents. A document's log weight is the sum of the
log ratio of both over its n-grams. Adding Gumbel noise to the log weights and taking the largest keys draws without
replacement in proportion to the weights.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import words as W
from orbitlake.operators.numbering import global_row_number

CELLS = 1 << 16
SMOOTHING = 0.5
SHARE = 0.8  # part of the documents that is drawn
SEED = 20240101


def _cells(texts: pa.Array, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and text of every unigram and bigram."""
    words = W.split(texts, lower=True)
    pairs, _, text_of_pair = W.grams(words, 2, salt=31)
    text = np.repeat(np.arange(len(texts)), words.counts())
    hashes = np.concatenate([W.mix(words.hashes, 32), pairs])
    return (hashes % np.uint64(cells)).astype(np.int64), np.concatenate([text, text_of_pair])


def _counted(cells: int):
    """The counts of every task, as one row per cell that occurs."""

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, texts in W.slices(batch["text"]):
                total += np.bincount(_cells(texts, cells)[0], minlength=cells)
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    return run


def cell_counts(docs: DataFrame, text_col: str = "text", cells: int = CELLS) -> np.ndarray:
    """N-grams of all rows by cell: ``cells`` numbers reach the driver, whatever the table's size."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted(cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = np.zeros(cells)
    for r in rows.collect():
        found[r.cell] = r.n
    return found


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models by cell, counts smoothed; zero where the target is empty."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    p, q = target + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _weighed(ratio: np.ndarray, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for at, texts in W.slices(batch["text"]):
                cell, text = _cells(texts, len(ratio))
                weight = np.bincount(text, ratio[cell], len(texts)).astype(np.float64)  # whole numbers where there are no words
                yield pa.record_batch({"id": batch["id"].slice(at, len(texts)).cast(id_type), "log_weight": pa.array(weight)})

    return run


def gumbel(seed: int, *columns: str) -> Column:
    """Gumbel noise that depends on the columns and the seed only."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: id, log_weight and key (log weight plus Gumbel noise of the id).

    Null and empty texts weigh 0. Repeated ids draw the same noise. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("log_weight", T.DoubleType())])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(_weighed(ratio, to_arrow_type(kind)), schema)
    return found.withColumn("key", F.col("log_weight") + gumbel(seed, "id")).withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The ``share`` of the documents with the largest keys: id, log_weight, key and place (1 for the largest key).

    ``target`` holds the texts to resemble; without any all weights are 0 and the draw is uniform. Ties in the key go
    to the smaller id. An empty table gives no rows. Counting runs jobs; the order is a distributed numbering.
    """
    ratio = log_ratio(cell_counts(target, text_col), cell_counts(docs, text_col))
    placed = global_row_number(weigh(docs, ratio, id_col, text_col, seed), [F.col("key").desc(), F.col(id_col).asc()], "place")
    wanted = math.ceil(share * docs.count())
    return placed.where(F.col("place") <= wanted)
