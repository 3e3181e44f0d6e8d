"""Periodic runs of words: maximal stretches that repeat themselves at least twice.

Words become numbers, texts one array with a different end mark each. A run of at least twelve words repeats at least
six of them after one period, so texts in which no six words in a row occur twice have none. The suffixes of the
others are sorted (prefix doubling), and the longest common prefixes of neighbours span the tree of LCP intervals,
which is walked from the leaves up. An interval of l common words joins the positions of its children; a pair of positions from two
children with different words before them is a maximal pair: it can be extended neither way. If its distance p is at
most l, the words from the first position to the end of the second occurrence have period p and are a run; nothing is
left to extend.

A node lists its positions in order; the word before a position is its class. Occurrences of the same l words within
a window of l words lie at equal distances, so those right of a position share one class, and of those left of it all
but the farthest have the class of the position itself. Looking at one neighbour therefore tells whether there is a
pair to report, and every step beyond a search reports a run or a multiple of its period.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import words as W

MIN_LENGTH = 12
SLICE_BYTES = 1 << 20
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples, equal for equal tuples."""
    rank = keys[0]
    for key in keys[1:]:
        rank = np.unique(rank * (int(key.max(initial=0)) + 1) + key, return_inverse=True)[1]
    return rank


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    """The ranks ``by`` places further on; beyond the end a rank below all others."""
    out = np.zeros(len(rank), np.int64)
    out[: max(len(rank) - by, 0)] = rank[by:] + 1
    return out


def repeated_grams(words: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For every position whether its n words occur again in its text. ``words`` holds an own end mark after every text."""
    rank, width = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while width < n:
        step = min(width, n - width)
        rank, width = _dense(rank, _ahead(rank, step)), width + step
    rank = _dense(rank, text)
    return np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for each place in it, the common prefix with the place before. Different texts must end
    in different marks."""
    n = len(words)
    ranks, widths = [np.unique(words, return_inverse=True)[1].astype(np.int64)], [1]
    while int(ranks[-1].max(initial=-1)) + 1 < n:
        ranks.append(_dense(ranks[-1], _ahead(ranks[-1], widths[-1])))
        widths.append(2 * widths[-1])
    order = np.argsort(ranks[-1])
    x, y, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for rank, width in zip(reversed(ranks), reversed(widths)):
        same = (x < n) & (y < n)
        same[same] = rank[x[same]] == rank[y[same]]
        x, y, common = x + width * same, y + width * same, common + width * same
    return order, np.concatenate([np.zeros(min(n, 1), np.int64), common])


def _join(one: list[int], other: list[int], common: int, least: int, before: list[int], found: dict) -> list[int]:
    """The positions of two children together; their maximal pairs at most ``common`` apart go to ``found``."""
    few, many = (one, other) if len(one) <= len(other) else (other, one)
    for i in few:
        at = bisect_right(many, i)
        if at < len(many) and many[at] <= i + common and before[many[at]] != before[i]:
            for j in many[at : bisect_right(many, i + common, at)]:
                _report(i, j, common, least, found)
        at = bisect_left(many, i - common)
        if at < len(many) and many[at] < i and before[many[at]] != before[i]:
            _report(many[at], i, common, least, found)
    if len(few) == 1:
        insort(many, few[0])
    else:
        many += few
        many.sort()
    return many


def _report(i: int, j: int, common: int, least: int, found: dict) -> None:
    period, length = j - i, j - i + common
    if length >= least and period < found.get((i, length), length):
        found[i, length] = period  # of multiples of a period the least


def runs_of(words: np.ndarray, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of numbers that may hold several texts, each followed by an end mark
    of its own; by start, then period. ``least`` is the least length."""
    order, common = suffixes(words)
    shortest = -(-least // 2)
    # the word before is the class; at the start of a text it is the mark of the text before, which no other position has
    before = [-1, *words.tolist()]
    found: dict[tuple[int, int], int] = {}
    deep = np.flatnonzero(common >= shortest)
    for block in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []:
        open_: list[tuple[int, list[int]]] = []  # intervals not yet closed: common prefix, positions of their closed children
        node = [int(order[block[0] - 1])]
        for position, lcp in zip(order[block].tolist(), common[block].tolist()):
            while open_ and open_[-1][0] > lcp:
                depth, positions = open_.pop()
                node = _join(positions, node, depth, least, before, found)
            if open_ and open_[-1][0] == lcp:
                node = _join(open_.pop()[1], node, lcp, least, before, found)
            open_.append((lcp, node))
            node = [position]
        while open_:
            depth, positions = open_.pop()
            node = _join(positions, node, depth, least, before, found)
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, given as its words."""
    names: dict[bytes, int] = {}
    flat: list[int] = []
    heads = [0]
    for i, words in enumerate(texts):
        flat += [names.setdefault(w, len(names)) for w in words]
        flat.append(-1 - i)  # no word, and different for every text
        heads.append(len(flat))
    array, bounds = np.array(flat, np.int64), np.array(heads, np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    again = repeated_grams(array, text, -(-least // 2)) if len(array) else np.zeros(0, bool)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    suspects = np.unique(text[again])
    if len(suspects):
        kept = np.isin(text, suspects)
        owner, first = text[kept], np.flatnonzero(kept)
        starts = np.searchsorted(owner, suspects)
        for start, length, period in runs_of(array[kept], least):
            own = int(owner[start])
            out[own].append((start - int(starts[np.searchsorted(suspects, own)]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([w for w, over in zip(words, np.cumsum(steps).tolist()) if not over])


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_words, ``runs`` (array of start, length, period in words, by start, then period)
    and ``collapsed``, its words but those that a run contains after its first period, joined by single spaces.

    Words are runs of bytes other than space and 0x09-0x0D, compared by their bytes. A run is at least ``least`` words
    and two periods long; its period is its smallest one, and no neighbouring word extends it. Null, empty and blank
    texts have no words, no runs and an empty collapsed text. Repeated rows are handled each by itself, null ids stay
    null, other columns are ignored, an empty table gives no rows. A text is searched whole by one task, in time
    n log² n; no shuffle.
    """

    def run(batches):
        for batch in batches:
            for at, texts in W.slices(batch["text"], SLICE_BYTES):
                texts = [t.as_buffer().to_pybytes().split() for t in texts]
                found = runs_of_texts(texts, least)
                yield pa.record_batch(
                    {
                        "id": batch["id"].slice(at, len(texts)),
                        "n_words": pa.array([len(t) for t in texts], pa.int64()),
                        "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], runs_type),
                        "collapsed": pa.array([collapsed(t, runs).decode() for t, runs in zip(texts, found)], pa.string()),
                    }
                )

    runs_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    fields = [("id", docs.schema[id_col].dataType), ("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("collapsed", T.StringType())]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields])).withColumnRenamed("id", id_col)
