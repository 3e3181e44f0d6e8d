"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces of equal length are interchangeable, and so are gaps of equal size. Range-sorted by size, pieces and gaps are
therefore runs (size, first rank, count), at most as many as there are sizes, whatever the number of documents. A
sweep gives every run of pieces, longest first, the run of its successor gaps (the smallest that fit), resolves
conflicts by rank (the first ranks take the gaps, the others go on to the next size or open sequences), updates the
gaps and repeats. The sweeps move runs; Spark numbers the pieces within their length and looks up every piece's place
by its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import tokens
from orbitlake.llm import words as W
from orbitlake.workspace import write_through

MAX_TOKENS = 1024
END_ID = 2
PLACES = "length long, first_rank long, end_rank long, per_sequence long, first_sequence long, first_offset long"


def _pieces(path: str, max_tokens: int, end_id: int, keep_ids: bool, id_type: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64), tokens.encoder(path)
        for batch in batches:
            for at, texts in W.slices(batch["text"], tokens.SLICE_BYTES):
                rows: list[tuple] = []
                for row, ids in enumerate(encoder.ids(texts), at):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start, piece = 0, 0
                    while start < len(ids):  # only the first piece may be shorter than the rest
                        length = max_tokens if start else (len(ids) - 1) % max_tokens + 1
                        raw = ids[start : start + length].tobytes()
                        rows.append((row, piece, start, length, zlib.crc32(raw), part, seen[length], raw if keep_ids else None))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                row, piece, start, length, crc, parts, rank, raw = zip(*rows)
                yield pa.record_batch(
                    {
                        "id": batch["id"].take(pa.array(row)).cast(id_type),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "_part": pa.array(parts, pa.int32()),
                        "_rank": pa.array(rank, pa.int64()),
                        "ids": pa.array(raw, pa.binary()),
                    }
                )

    return run


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length, as rows of ``PLACES``: piece of rank r (of its length) in
    first_rank <= r < end_rank goes to sequence first_sequence + j // per_sequence, at first_offset +
    (j % per_sequence) * length, where j = r - first_rank. Greedy best fit, longest pieces first."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size → runs (first sequence, count)
    sizes: list[int] = []
    opened, places = 0, []

    def leave(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            successor = bisect_left(sizes, length)
            if successor < len(sizes):
                size = sizes[successor]
                first, count = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[successor]
            else:
                size, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            per = size // length  # as long as a gap still fits, it is the best one for the next piece of this length
            taken = min(left, count * per)
            places.append((length, rank, rank + taken, per, first, capacity - size))
            full, rest = divmod(taken, per)
            leave(size - per * length, first, full)
            leave(size - rest * length if rest else 0, first + full, 1)
            untouched = count - full - (rest > 0)
            leave(size, first + count - untouched, untouched)
            rank, left = rank + taken, left - taken
    return places


def pack(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset and, unless
    ``keep_ids`` is false, ids (little-endian unsigned 32-bit).

    Null and empty texts hold the end id alone. Repeated rows are packed as often as they occur; null ids stay null.
    Documents over ``max_tokens`` are cut so that only the first piece is shorter. Other columns are ignored. An empty
    table gives no rows. Runs a job to tokenize and one for the histogram of lengths (``max_tokens`` rows at most).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("piece", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
            T.StructField("_part", T.IntegerType()),
            T.StructField("_rank", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    cut = _pieces(vocabulary or tokens.vocabulary(), max_tokens, end_id, keep_ids, to_arrow_type(kind))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = write_through(source.mapInArrow(cut, schema), "pieces")
    by_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.createDataFrame(best_fit_runs(counts, max_tokens), PLACES)
    # ranks go on from part to part; a length has one row per part here
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    ranked = pieces.join(starts, ["length", "_part"]).withColumn("_rank", F.col("_first") + F.col("_rank"))
    fits = (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    nth = F.col("_rank") - F.col("first_rank")
    return ranked.join(F.broadcast(places), fits).select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * ranked["length"]).alias("offset"),
        *(["ids"] if keep_ids else []),
    )
