"""Exact substring deduplication by fixed-block anchors.

To find every run of ``window`` words that occurs twice, blocks of half a window are enough: whichever place a
window starts at, it holds a whole block of ``(window + 1) // 2`` words that starts at a multiple of that length.
The blocks are the index; every rolling run of the same length probes it. Windows around a hit are then extended:
each is hashed whole, and those that occur a second time cover the words of maximal repeats.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orbitlake.llm import exchange as X
from orbitlake.llm import words as W

WINDOW = 35


def _block(window: int) -> int:
    return (window + 1) // 2


def _long_enough(words: W.Words, window: int) -> W.Words:
    """Texts shorter than a window have no rolling runs."""
    counts = words.counts()
    keep = np.repeat(counts >= window, counts)
    first = np.concatenate([[0], np.cumsum(np.where(counts >= window, counts, 0))])
    return W.Words(words.data, words.starts[keep], words.ends[keep], first, words.hashes[keep])


class _Chunk:
    """Rolling runs and windows of the texts of one chunk."""

    def __init__(self, texts, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.all = W.split(W.string_array(texts))
        self.words = _long_enough(self.all, window)
        self.runs, self.at, self.text = W.grams(self.words, _block(window))
        self.marks = X.Marks(self.runs, buckets)

    def blocks(self) -> np.ndarray:
        return (self.at - self.words.first[self.text]) % _block(self.window) == 0

    def windows(self, hits: pa.Table) -> tuple[np.ndarray, X.Marks]:
        """Places of the windows that hold a hit, and their hashes."""
        hit = np.zeros(len(self.words.hashes) + 1, np.int64)
        hit[self.at[self.marks.answered(hits)] + 1] = 1
        before = np.cumsum(hit)
        hashes, at, _ = W.grams(self.words, self.window, salt=5)
        reach = self.window - _block(self.window) + 1
        near = before[at + reach] > before[at]
        return at[near], X.Marks(hashes[near], self.buckets, wide=True)


def _index_and_probe(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table["text"], window, buckets)
        return chunk.marks.packed(table[X.CHUNK][0].as_py(), chunk.blocks())

    return run


def _extend(window: int, buckets: int):
    def run(key, texts: pa.Table, hits: pa.Table) -> pa.Table:
        _, windows = _Chunk(texts["text"], window, buckets).windows(hits)
        return windows.packed(key[0].as_py())

    return run


def _cover(window: int, buckets: int, ids: pa.DataType):
    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        stage = np.array(answers["stage"].to_pylist(), np.int64)
        chunk = _Chunk(texts["text"], window, buckets)
        at, windows = chunk.windows(answers.filter(pa.array(stage == 1)))
        twice = at[windows.answered(answers.filter(pa.array(stage == 2)))]
        steps = np.zeros(len(chunk.words.hashes) + 1, np.int64)
        np.add.at(steps, twice, 1)
        np.add.at(steps, twice + window, -1)
        covered = np.cumsum(steps)[:-1] > 0
        counts, spans, kept, removed, at = chunk.all.counts(), [], [], [], 0
        for text, n in zip(W.string_array(texts["text"]).to_pylist(), counts):
            gone = np.zeros(n, bool)
            if n >= window:
                gone, at = covered[at : at + n], at + n
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            parts = text.encode().split()
            kept.append(b" ".join(compress(parts, ~gone) if gone.any() else parts).decode())
            removed.append(int(gone.sum()))
        return pa.table(
            {
                "id": texts["id"].combine_chunks().cast(ids),
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.string()),
            }
        )

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed, spans (maximal runs of words that are covered by a repeated
    window; start and exclusive end) and kept (the other words, joined by one space).

    Null text: no words. Texts shorter than a window keep all words. Repeated rows, with or without the same id,
    are texts like any other, so they cover each other. Other columns are ignored. An empty table gives none.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type

    n_bytes = X.text_bytes(docs, text_col)
    chunks, buckets = X.chunk_count(n_bytes), X.bucket_count(n_bytes / 5)
    texts = docs.select(X.chunk_of(chunks, id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_chunk = texts.groupBy(X.CHUNK)

    def answers(sent: DataFrame, stage: int, **how) -> DataFrame:
        return sent.groupBy(X.BUCKET).applyInArrow(X.shared_marks(**how), X.ANSWER).withColumn("stage", F.lit(stage))

    hits = answers(by_chunk.applyInArrow(_index_and_probe(window, buckets), X.PACKED), 1, flagged=True)
    near = by_chunk.cogroup(hits.groupBy(X.CHUNK)).applyInArrow(_extend(window, buckets), X.PACKED)
    repeats = answers(near, 2, flagged=False, wide=True)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("kept", T.StringType()),
        ]
    )
    found = by_chunk.cogroup(hits.unionByName(repeats).groupBy(X.CHUNK)).applyInArrow(_cover(window, buckets, to_arrow_type(kind)), schema)
    return found.withColumnRenamed("id", id_col)
