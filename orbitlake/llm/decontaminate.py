"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a span of words; its hash ignores the words under zeros, so a substitution there does not
hide a copy. The hashes of all benchmark spans are joined with those of all spans of the documents; around every hit
the item is laid over the document, and the longest stretch of which few words differ is reported if it is long enough.

The benchmark is the stated query set: it is met block by block, each block bounded by ``BLOCK_SPANS``, and a block
is broadcast. Documents never move.
"""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import words as W

MASKS = ("110100110101", "101101001011", "111011001", "1111111")
MIN_WORDS = 13  # shortest overlap to report; shorter items must be there whole
MIN_AGREEMENT = 0.8
BLOCK_SPANS = 4_000_000  # hashes of one block (32 MB)


def _spans(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every span of one text under a mask, and the span's first word."""
    counts = np.maximum(np.diff(first) - len(mask) + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) - (np.cumsum(counts) - counts)[text] + first[text]
    total = np.full(len(at), len(mask), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total += hashes[at + i] * np.uint64(W.GRAM_BASE * (2 * i + 3) & (2**64 - 1))
    return W.mix(total, 21), at


class Block:
    """Some benchmark items: their words and the hashes of their spans under every mask."""

    def __init__(self, ids: list, texts: list[str], masks: tuple[str, ...], min_words: int):
        words = W.split(pa.array(texts, pa.large_string()), lower=True)
        counts = words.counts()
        self.ids, self.hashes, self.first = ids, words.hashes, words.first
        shortest = min(map(len, masks))
        # items too short for a mask are sought whole, word by word
        self.masks = [*masks, *("1" * n for n in range(1, shortest) if (counts == n).any())]
        self.tables = []
        item = np.repeat(np.arange(len(ids)), counts)
        for mask in self.masks:
            spans, at = _spans(words.hashes, words.first, mask)
            if mask not in masks:
                whole = counts[item[at]] == len(mask)
                spans, at = spans[whole], at[whole]
            order = np.argsort(spans, kind="stable")
            lookup = np.zeros(1 << 20, bool)
            lookup[spans >> np.uint64(44)] = True
            self.tables.append((mask, spans[order], at[order], item[at[order]], lookup))
        self.least = np.minimum(counts, min_words)

    def overlaps(self, texts: pa.Array, agreement: float):
        """(text, item, first word, words, agreeing words, places) of the longest overlap of each text and item."""
        words = W.split(texts, lower=True)
        text = np.repeat(np.arange(len(texts)), words.counts())
        diagonals = set()
        for mask, spans, where, item, lookup in self.tables:
            found, at = _spans(words.hashes, words.first, mask)
            likely = np.flatnonzero(lookup[found >> np.uint64(44)])
            low, high = (np.searchsorted(spans, found[likely], side) for side in ("left", "right"))
            for i, a, b in zip(at[likely[high > low]].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                # every place of the span in the benchmark: as many as items repeat it
                diagonals.update((int(text[i]), int(item[j]), i - int(where[j] - self.first[item[j]])) for j in range(a, b))
        best: dict[tuple[int, int], tuple] = {}
        places: dict[tuple[int, int], int] = defaultdict(int)
        for d, item, at in sorted(diagonals):
            found = self._stretch(words, d, item, at, agreement)
            if found:
                places[d, item] += 1
                best[d, item] = max(best.get((d, item), (0,)), found)
        for (d, item), (n, agreeing, start) in best.items():
            yield d, item, -start, n, agreeing, places[d, item]

    def _stretch(self, words: W.Words, d: int, item: int, at: int, agreement: float):
        """(words, agreeing words, - first word) of the longest stretch, of the item laid over text d at word ``at``, in
        which the share ``agreement`` of the words agrees; of equally long ones the best, then the first."""
        low, high = max(at, int(words.first[d])), min(at + int(self.first[item + 1] - self.first[item]), int(words.first[d + 1]))
        shift = int(self.first[item]) - at
        same = words.hashes[low:high] == self.hashes[low + shift : high + shift]
        # in whole numbers, so that a share of just ``agreement`` counts: a stretch qualifies if its sum is not negative
        share = Fraction(str(agreement))
        sums = np.concatenate([[0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))])
        # the first start from which some end qualifies is where the least sum so far falls
        lowest = np.minimum.accumulate(sums)
        longest = int((np.arange(len(sums)) - np.searchsorted(-lowest, -sums)).max())
        if longest < max(self.least[item], 1):
            return None
        agreeing = np.concatenate([[0], np.cumsum(same)])
        within = agreeing[longest:] - agreeing[: len(agreeing) - longest]
        start = int(np.argmax(within))
        return longest, int(within[start]), -(low - int(words.first[d]) + start)


def _search(block, agreement: float, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for at, texts in W.slices(batch["text"]):
                rows = [(at + d, *rest) for d, *rest in block.value.overlaps(texts, agreement)]
                if rows:
                    row, item, start, n, agreeing, places = zip(*rows)
                    yield pa.record_batch(
                        {
                            "id": batch["id"].take(pa.array(row)).cast(id_type),
                            "item": pa.array([block.value.ids[i] for i in item], item_type),
                            "start": pa.array(start, pa.int64()),
                            "n_words": pa.array(n, pa.int64()),
                            "n_agreeing": pa.array(agreeing, pa.int64()),
                            "n_places": pa.array(places, pa.int64()),
                        }
                    )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_words: int = MIN_WORDS,
    agreement: float = MIN_AGREEMENT,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document row and benchmark item that overlap: id, item, the longest overlap (first word in the
    document, words, agreeing words) and the number of places.

    Words are split at ASCII white space and A-Z lower-cased. An overlap has at least ``min_words`` words (or the whole
    item, if that is shorter), of which the share ``agreement`` agrees. Null and empty texts overlap nothing. Rows that
    repeat are reported as often; an item given twice is two items. Other columns are ignored; an empty table on either
    side gives no rows. Counting the benchmark and fetching its blocks run jobs.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    n_bytes = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / 2 * len(masks) / BLOCK_SPANS))
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", kinds[0]), T.StructField("item", kinds[1])] + [T.StructField(c, T.LongType()) for c in ("start", "n_words", "n_agreeing", "n_places")])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        if rows:
            block = spark.sparkContext.broadcast(Block([r.item for r in rows], [r.text for r in rows], masks, min_words))
            found = found.unionByName(source.mapInArrow(_search(block, agreement, *map(to_arrow_type, kinds)), schema))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})
