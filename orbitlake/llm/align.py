"""Alignment of two tokenizations of the same text, and how often every pair of ids is linked in the whole corpus.

Both tokenizers cut the same bytes, so where a token of each ends at the same byte the text falls into groups. The
two arrays of token ends are compared at the current shift between their indexes: exponential probing doubles the
stretch as long as the ends agree, so a stretch of one-to-one tokens costs a few block comparisons. Where the ends differ, the side that lies behind advances until they meet; that group
is irregular, and the shift changes by the difference of its sizes. Any common end is a place to start from, so a chunk
is cut into lanes there, and numpy moves all lanes at once.

Texts are aligned in chunks. A chunk names each of its distinct id pairs once, so the corpus-wide count adds chunks,
not tokens; the counts come back to the chunk, and its documents look up their links by number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import bpe
from orbitlake.llm import words as W
from orbitlake.llm.sizes import broadcast_if_small
from orbitlake.workspace import write_through

#: Text of a chunk. Larger chunks send fewer pairs and take more memory.
CHUNK_BYTES = 4 << 20
SLICE_BYTES, ROW_BYTES = 1 << 20, 64
#: Tokens of a lane, and the ends a probe compares at first and at most.
LANE, FIRST_PROBE, LAST_PROBE = 512, 4, 64


def pieces_vocabulary(name: str = "piece_bpe_32k.model") -> str:
    return bpe.vocabulary(name)


@cache
def _pieces(path: str):
    """The sentence-piece model at ``path`` and the bytes of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(size) for p in [model.id_to_piece(i)]]
    return model, spelled


def _lanes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the work may be taken up: indexes behind common ends, at most about ``LANE`` tokens of ``a`` apart
    where there are any. The first is (0, 0)."""
    i = np.arange(LANE, len(a), LANE)
    j = np.searchsorted(b, a[i])
    live = np.arange(len(i))
    while len(live):  # whichever side lies behind advances, as within an irregular group
        live = live[(i[live] < len(a) - 1) & (j[live] < len(b) - 1)]
        x, y = a[i[live]], b[j[live]]
        i[live[x < y]] += 1
        j[live[y < x]] += 1
        live = live[x != y]
    found = a[i] == b[np.minimum(j, len(b) - 1)] if len(b) else np.zeros(len(i), bool)
    i, first = np.unique(i[found] + 1, return_index=True)
    return np.concatenate([[0], i]), np.concatenate([[0], j[found][first] + 1])


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two rising arrays of ends: which tokens of each end together with one of the other.

    Many lanes advance at once. Each compares its next ends at its present shift j - i, twice as many after every
    stretch that agreed to its end; a difference stops the stretch, the lane resolves that group alone, and goes on at
    the shift that comes of it.
    """
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if not len(a) or not len(b):
        return in_a, in_b
    i, j = _lanes(a, b)
    stop = np.append(i[1:], len(a))
    width = np.full(len(i), FIRST_PROBE)
    live = np.flatnonzero((i < stop) & (j < len(b)))
    while len(live):
        agreed = np.zeros(len(live), np.int64)
        for size in np.unique(width[live]).tolist():
            own = np.flatnonzero(width[live] == size)
            steps = np.arange(size)
            at_i, at_j = i[live[own], None] + steps, j[live[own], None] + steps
            inside = (at_i < stop[live[own], None]) & (at_j < len(b))
            same = (a[np.minimum(at_i, len(a) - 1)] == b[np.minimum(at_j, len(b) - 1)]) & inside
            whole = same.all(1)
            agreed[own] = run = np.where(whole, size, same.argmin(1))
            marked = steps < run[:, None]
            in_a[at_i[marked]] = True
            in_b[at_j[marked]] = True
        i[live] += agreed
        j[live] += agreed
        grown = agreed == width[live]
        width[live] = np.where(grown, np.minimum(2 * width[live], LAST_PROBE), FIRST_PROBE)
        live = live[(i[live] < stop[live]) & (j[live] < len(b))]
        own = live[a[i[live]] != b[j[live]]]
        while len(own):
            x, y = a[i[own]], b[j[own]]
            met = x == y
            in_a[i[own[met]]] = True
            in_b[j[own[met]]] = True
            i[own] += x <= y
            j[own] += y <= x
            own = own[~met]
            own = own[(i[own] < stop[own]) & (j[own] < len(b))]
        live = live[(i[live] < stop[live]) & (j[live] < len(b))]
    return in_a, in_b


class _Speller:
    """The tokens of both vocabularies: their bytes, and how they are written before a comma or at the end of a group."""

    def __init__(self, path_a: str, path_b: str):
        self.encoder = bpe.encoder(path_a, False)
        self.model, self.bytes_b = _pieces(path_b)
        self.bytes_a = self.encoder.bytes_of
        self.width_a, self.width_b = (np.array([len(x) for x in s], np.int64) for s in (self.bytes_a, self.bytes_b))
        self.written = [f"{i}{mark}" for n, end in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for mark in (",", end) for i in range(n)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of every text by both vocabularies; none for a text that either does not spell back."""
        led = self.encoder.encode([f" {t}" if t else "" for t in texts])
        out, none = [], np.zeros(0, np.int32)
        for text, packed, pieces in zip(texts, led, self.model.encode([t or "" for t in texts], num_threads=1)):
            ids, whole = np.frombuffer(packed, "<i4"), b" " + text.encode() if text else b""
            # byte-level tokens spell any text back
            good = text and b"".join(map(self.bytes_b.__getitem__, pieces)) == whole
            out.append((ids, np.array(pieces, np.int32)) if good else (none, none))
        return out

    def written_groups(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[str]:
        """Every token as written, in the order of the groups: those of ``a``, then those of ``b``."""
        group_a, group_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        before_b = np.searchsorted(group_b, group_a)  # tokens of b in earlier groups
        upto_a = np.searchsorted(group_a, group_b, "right")
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before_b] = a + in_a * len(self.bytes_a)
        codes[np.arange(len(b)) + upto_a] = 2 * len(self.bytes_a) + b + in_b * len(self.bytes_b)
        return list(map(self.written.__getitem__, codes.tolist()))


def _chunk(speller: _Speller, tokens: list[tuple[np.ndarray, np.ndarray]], ids: pa.Array, name: int) -> pa.RecordBatch:
    """One row per document, and on the first one the distinct id pairs of all and their counts."""
    n_a, n_b = (np.array([len(t[side]) for t in tokens]) for side in (0, 1))
    a, b = (np.concatenate([t[side] for t in tokens]).astype(np.int64) for side in (0, 1))
    # the texts one after the other: both sides of each end at the same byte
    in_a, in_b = common_ends(np.cumsum(speller.width_a[a]), np.cumsum(speller.width_b[b]))
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    links = np.diff(np.concatenate([[0], np.cumsum(in_a)])[np.concatenate([[0], ends_a])])
    written = speller.written_groups(a, b, in_a, in_b)
    bounds = np.concatenate([[0], ends_a + ends_b]).tolist()
    groups = ["".join(written[x:y])[:-1] if y > x else None for x, y in zip(bounds, bounds[1:])]
    pairs, place, counts = np.unique((a[in_a] << 32) | b[in_b], return_inverse=True, return_counts=True)
    place, ends = place.astype("<i4"), np.cumsum(links)
    rest = len(ids) - 1
    return pa.record_batch(
        {
            "id": ids,
            "chunk": pa.array(np.full(len(ids), name, np.int64)),
            "n_a": pa.array(n_a, pa.int64()),
            "n_b": pa.array(n_b, pa.int64()),
            "n_groups": pa.array(links, pa.int64()),
            "groups": pa.array(groups, pa.string()),
            "links": pa.array([place[e - n : e].tobytes() for e, n in zip(ends, links)], pa.binary()),
            "pairs": pa.array([pairs, *[None] * rest], pa.list_(pa.int64())),
            "counts": pa.array([counts, *[None] * rest], pa.list_(pa.int64())),
        }
    )


def _aligned(path_a: str, path_b: str):
    def run(batches):
        from pyspark import TaskContext

        name, speller = TaskContext.get().partitionId() << 32, _Speller(path_a, path_b)
        tokens, ids, weight = [], [], 0
        for batch in batches:
            for at, texts in W.slices(batch["text"], SLICE_BYTES):
                tokens += speller.encode(texts.to_pylist())
                ids.append(batch["id"].slice(at, len(texts)))
                weight += texts.nbytes + ROW_BYTES * len(texts)
                if weight >= CHUNK_BYTES:
                    yield _chunk(speller, tokens, pa.concat_arrays(ids), name)
                    tokens, ids, weight, name = [], [], 0, name + 1
        if ids:
            yield _chunk(speller, tokens, pa.concat_arrays(ids), name)

    return run


def _looked_up(columns: list[str]):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        count, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
        count[told["nth"].to_numpy()] = told["count"].to_numpy()
        best[told["nth"].to_numpy()] = told["best"].to_numpy()
        places = [np.frombuffer(x, "<i4") for x in docs["links"].to_pylist()]
        sums = {
            "n_links": [len(x) for x in places],
            "n_best": [int(best[x].sum()) for x in places],
            "count_sum": [int(count[x].sum()) for x in places],
        }
        return pa.table({c: docs[c] for c in columns} | {c: pa.array(x, pa.int64()) for c, x in sums.items()})

    return run


def align(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    keep: Callable[[Column], Column] = lambda groups: groups,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: its id, n_a and n_b (tokens of a space and the text by the byte-level vocabulary
    ``path_a`` and the sentence-piece model ``path_b``, without special tokens), n_groups, ``groups`` as text
    (``a1,a2|b1;a3|b2,b3``), n_links (pairs of tokens that end together, one per group), n_best (links whose pair is
    the most frequent one of its second id in the whole corpus, ties included) and count_sum (over the links, how often
    their pair is linked in the whole corpus).

    Null and empty texts, and texts that either side does not spell back, have zeros and null groups. Repeated rows count
    as often as they occur, null ids stay null, other columns are ignored, an empty table gives no rows. ``keep`` says
    what is stored of the groups, such as a digest. A text is aligned whole by one task. Distinct pairs are joined by a
    shuffle once they are too many to broadcast.
    """
    kind, long, longs = docs.schema[id_col].dataType, T.LongType(), T.ArrayType(T.LongType())
    own = [("id", kind), ("chunk", long), ("n_a", long), ("n_b", long), ("n_groups", long), ("groups", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in [*own, ("links", T.BinaryType()), ("pairs", longs), ("counts", longs)]])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = _aligned(path_a or bpe.vocabulary(), path_b or pieces_vocabulary())
    aligned = write_through(source.mapInArrow(run, schema).withColumn("groups", keep(F.col("groups"))), "aligned")
    told = aligned.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("nth", "told"))
    told = told.select("chunk", "nth", F.col("told.pairs").alias("pair"), F.col("told.counts").alias("n"))
    counts = write_through(told.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counts.groupBy(second.alias("_b")).agg(F.max("count").alias("_highest"))  # one row per id of the second vocabulary
    rated = counts.join(F.broadcast(highest), second == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_highest")).cast("long").alias("best"))
    rated = broadcast_if_small(write_through(rated, "rated-pairs"))
    answers = told.join(rated, "pair").select(F.col("chunk").alias("_of"), "nth", "count", "best")
    kept = [c for c, _ in own if c != "chunk"]
    groups = aligned.schema["groups"].dataType
    out = T.StructType([T.StructField(c, groups if c == "groups" else t) for c, t in own if c != "chunk"] + [T.StructField(c, long) for c in ("n_links", "n_best", "count_sum")])
    found = aligned.drop("pairs", "counts").groupBy("chunk").cogroup(answers.groupBy("_of")).applyInArrow(_looked_up(kept), out)
    return found.withColumnRenamed("id", id_col)
