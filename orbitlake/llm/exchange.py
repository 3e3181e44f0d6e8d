"""Counting 64-bit hashes that occur in several places, without one Spark row per hash.

Rows are dealt to chunks by a hash of their content. A chunk sends every distinct hash once, whatever the
number of its rows that hold it, packed as sorted 32- or 64-bit marks in one row per bucket; the bucket comes
from other bits of the hash. So a hash held by a third of all rows costs a bucket one mark per chunk. The
bucket answers each chunk with one bit per mark (or one byte with a weight), and the chunk, which can compute
its marks again, knows which of its hashes are shared and with how many chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, BUCKET = "_chunk", "_bucket"
PACKED = f"{CHUNK} int, {BUCKET} int, marks binary, counts binary, flag binary"
ANSWER = f"{CHUNK} int, {BUCKET} int, answer binary"
CHUNK_BYTES = 2 << 20
BUCKET_MARKS = 1 << 20


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def chunk_count(n_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / CHUNK_BYTES))


def bucket_count(n_marks: float) -> int:
    return max(1, math.ceil(n_marks / BUCKET_MARKS))


def chunk_of(n_chunks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n_chunks)).cast("int").alias(CHUNK)


class Marks:
    """The distinct hashes of a chunk by bucket, and where each given hash is among them."""

    def __init__(self, hashes: np.ndarray, buckets: int, wide: bool = False):
        kind = np.uint64 if wide else np.uint32
        bucket = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashes.astype(kind), bucket))
        bucket, mark = bucket[order], hashes[order].astype(kind)
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (mark[1:] != mark[:-1])
        self.heads = np.flatnonzero(new)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.order, self.mark = order, mark[self.heads]
        self.counts = np.minimum(np.diff(np.append(self.heads, len(order))), 255).astype(np.uint8)
        self.buckets, self.begin = np.unique(bucket[self.heads], return_index=True)
        self.end = np.append(self.begin[1:], len(self.heads))

    def packed(self, chunk: int, flag: np.ndarray | None = None) -> pa.Table:
        """One row per bucket; ``flag``: a truth value for each given hash, or-ed over equal ones."""
        any_flag = np.zeros(len(self.heads), bool)
        if flag is not None and len(self.heads):
            any_flag = np.logical_or.reduceat(flag[self.order], self.heads)
        rows = list(zip(self.begin, self.end))
        return pa.table(
            {
                CHUNK: pa.array([chunk] * len(rows), pa.int32()),
                BUCKET: pa.array(self.buckets, pa.int32()),
                "marks": pa.array([self.mark[a:b].tobytes() for a, b in rows], pa.binary()),
                "counts": pa.array([self.counts[a:b].tobytes() for a, b in rows], pa.binary()),
                "flag": pa.array([np.packbits(any_flag[a:b]).tobytes() for a, b in rows], pa.binary()),
            }
        )

    def answered(self, table: pa.Table) -> np.ndarray:
        """For each given hash whether its bucket answered yes."""
        yes = np.zeros(len(self.heads), bool)
        at = {int(b): (int(x), int(y)) for b, x, y in zip(self.buckets, self.begin, self.end)}
        for bucket, answer in zip(table[BUCKET].to_pylist(), table["answer"].to_pylist()):
            a, b = at[bucket]
            yes[a:b] = np.unpackbits(np.frombuffer(answer, np.uint8), count=b - a).astype(bool)
        return yes[self.place]


    def weights(self, table: pa.Table) -> np.ndarray:
        """For each given hash the byte that its bucket answered, 0 without an answer."""
        given = np.zeros(len(self.heads), np.uint8)
        at = {int(b): (int(x), int(y)) for b, x, y in zip(self.buckets, self.begin, self.end)}
        for bucket, answer in zip(table[BUCKET].to_pylist(), table["answer"].to_pylist()):
            given[slice(*at[bucket])] = np.frombuffer(answer, np.uint8)
        return given[self.place]


def log_weight(count: np.ndarray) -> np.ndarray:
    """A count as a byte: 1 + 8 log2, at most 255."""
    return np.clip(1 + 8 * np.log2(count), 1, 255).astype(np.uint8)


def _bits(columns: list[bytes], lengths: np.ndarray) -> np.ndarray:
    if not len(lengths):
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=n) for c, n in zip(columns, lengths)]).astype(bool)


def shared_marks(flagged: bool = False, wide: bool = False, weighed: bool = False):
    """Of one bucket: the answer to every chunk, a bit per mark, set where the hash occurs at least twice
    (and, if ``flagged``, carries the flag somewhere). ``weighed``: a byte per mark, 0 or the log weight of how often
    the hash occurs."""
    kind = np.uint64 if wide else np.uint32

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(m, kind) for m in table["marks"].to_pylist()]
        lengths = np.array([len(p) for p in parts])
        marks = np.concatenate(parts)
        order = np.argsort(marks, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = marks[order][1:] != marks[order][:-1]
        heads = np.flatnonzero(new)
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in table["counts"].to_pylist()])
        held = np.add.reduceat(counts[order].astype(np.int64), heads)
        yes = held > 1
        if flagged:
            yes &= np.logical_or.reduceat(_bits(table["flag"].to_pylist(), lengths)[order], heads)
        told = np.where(yes, log_weight(held), 0).astype(np.uint8) if weighed else yes
        out = np.empty(len(order), told.dtype)
        out[order] = told[np.cumsum(new) - 1]
        ends = np.cumsum(lengths)
        answers = [out[e - n : e] if weighed else np.packbits(out[e - n : e]) for e, n in zip(ends, lengths)]
        return pa.table(
            {
                CHUNK: table[CHUNK],
                BUCKET: table[BUCKET],
                "answer": pa.array([a.tobytes() for a in answers], pa.binary()),
            }
        )

    return answer
