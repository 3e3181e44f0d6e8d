"""Exact Jaccard join of word-shingle sets by universe partitioning and the pigeonhole principle.

Two sets of similar sizes that reach the threshold differ in at most k shingles. Hash all shingles into segments;
a differing shingle touches one segment. Give segments thresholds 0 (subsets must be equal; weight 1) or 1 (they may
differ by one shingle; weight 2): if the weights of any segments add up to more than k, one of these segments agrees.
A threshold of 1 is met through signatures of the subset and of all its one-deletion neighbours. ``plan`` allocates
thresholds per size band by cost; per set, the segments to probe are then chosen by how often their signatures occur.

1. Sets are hashed; documents with equal sets form one class, whose least id stands for it.
2. Signatures are counted (``exchange``). A set whose segments that nobody else shares outweigh k has no partner.
3. Nor has a set of which too few shingles occur in any other set that remains. The rest is linked through a few of
   its shared signatures to their most popular holders, and verified.
4. Signatures whose holders all are in one component now need no more probing. A set that still lacks weight probes
   the rarest other ones, and is compared with the pieces of components that hold them, so no link between different
   components is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import exchange as X
from orbitlake.llm import words as W
from orbitlake.llm.components import components
from orbitlake.workspace import write_through

SHINGLE = 5
THRESHOLD = 0.75
KEYS = 8  # shared signatures that link a set to their least holder before the exact probing
PIECE = 512  # sets compared with each other in one group
SHARED_PART = 0.2  # the plan lets a set of which so much is shared with others still be settled by its own part


# --- sets ------------------------------------------------------------------------------------------------------------


@dataclass
class Sets:
    """Sorted distinct shingle hashes of many texts: those of text d are ``hashes[first[d]:first[d + 1]]``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self, d: int) -> np.ndarray:
        return self.hashes[self.first[d] : self.first[d + 1]]


def shingle_sets(texts: pa.Array, n: int) -> Sets:
    """Sets of n-word shingles, A-Z in lower case; a text of fewer words is one shingle, one without words none."""
    words = W.split(texts, lower=True)
    hashes, _, text = W.grams(words, n)
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < n))
    whole = W.run_hashes(words.hashes, words.first[short], words.first[short + 1], salt=4)
    hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return Sets(hashes[new], np.searchsorted(text[new], np.arange(len(texts) + 1)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


# --- size bands and thresholds -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Segments of one size band: the first ``wide`` have threshold 1, all others 0; more than k is ``need``."""

    segments: int
    wide: int
    need: int


@cache
def bands(percent: int, largest: int) -> tuple[int, ...]:
    """First sizes of the bands: a partner of a set of band j that is not smaller is in band j or j + 1."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    return tuple(starts)


@cache
def plan(percent: int, low: int, high: int) -> Plan:
    """Segments for pairs whose smaller set has low <= size < high.

    Cost is the number of signatures. An allocation must let a set of ``low`` shingles, of which ``SHARED_PART`` occur
    elsewhere, expect more than ``need`` of weight in segments that nobody shares.
    """
    most = (high - 1) + (high - 1) * 100 // percent
    need = math.floor(most * (100 - percent) / (100 + percent)) + 1
    best, cheapest = Plan(need, 0, need), math.inf
    for slack in (1.0, 1.2, 1.4, 1.6, 1.8, 2.0):
        weight = math.ceil(slack * need)
        for part in (0, 0.25, 0.5, 0.75, 1):
            wide = math.floor(part * weight / 2)
            segments = weight - wide
            mean = low / segments
            own = mean * (1 - SHARED_PART)
            free = (segments - wide) * (1 - math.exp(-own)) + 2 * wide * (1 - math.exp(-own) * (1 + own))
            cost = segments + wide * mean
            if free >= 1.08 * need and cost < cheapest:
                best, cheapest = Plan(segments, wide, need), cost
    return best if cheapest < math.inf else Plan(2 * need, 0, need)


@dataclass
class Signatures:
    """Signatures of many sets. Each belongs to a segment; each segment to a set and a side (own band, band below)."""

    hashes: np.ndarray
    segment: np.ndarray
    owner: np.ndarray  # of each segment: 2 * set + side
    weight: np.ndarray  # of each segment
    empty: np.ndarray  # of each segment
    need: np.ndarray  # of each owner; 0 where the set has no such side

    def settled(self, busy: np.ndarray) -> np.ndarray:
        """Owners whose segments without a busy signature weigh enough."""
        return self.free(busy) >= self.need

    def free(self, busy: np.ndarray) -> np.ndarray:
        idle = np.bincount(self.segment, busy, len(self.owner)) == 0
        return np.bincount(self.owner, self.weight * idle, len(self.need))


def signatures(sets: Sets, percent: int) -> Signatures:
    sizes = sets.sizes
    starts = np.array(bands(percent, int(sizes.max(initial=1)) + 1))
    band = np.searchsorted(starts, sizes, "right") - 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    share = W.mix(sets.hashes, 11)
    place = W.mix(sets.hashes, 12)
    need = np.zeros(2 * len(sizes), np.int64)
    found: list[tuple] = []
    base = 0
    for side in (0, 1):
        own = band - side
        has = (sizes > 0) & (own >= 0)
        plans = {b: plan(percent, int(starts[b]), int(starts[b + 1])) for b in np.unique(own[has])}
        each = [plans[b] if h else Plan(0, 0, 0) for b, h in zip(own, has)]
        segments, wide = np.array([p.segments for p in each], np.int64), np.array([p.wide for p in each], np.int64)
        need[side::2] = [p.need for p in each]
        begin = np.cumsum(segments) - segments
        owner = np.repeat(np.arange(len(sizes)), segments)
        number = np.arange(len(owner)) - begin[owner]
        is_wide = number < wide[owner]
        inside = has[text]
        at = begin[text[inside]] + (place[inside] % segments[text[inside]].astype(np.uint64)).astype(np.int64)
        sums, filled = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.int64)
        np.add.at(sums, at, share[inside])
        np.add.at(filled, at, 1)
        name = W.mix(number.astype(np.uint64) + (own[owner].astype(np.uint64) << np.uint64(40)), 13)
        less = is_wide[at]
        found.append((W.mix(sums + name, 14), base + np.arange(len(owner)), 2 * owner + side, 1 + is_wide, filled == 0))
        found.append((W.mix(sums[at[less]] - share[inside][less] + name[at[less]], 14), base + at[less]))
        base += len(owner)
    full = [f for f in found if len(f) == 5]
    return Signatures(
        np.concatenate([f[0] for f in found]),
        np.concatenate([f[1] for f in found]),
        np.concatenate([f[2] for f in full]),
        np.concatenate([f[3] for f in full]),
        np.concatenate([f[4] for f in full]),
        need,
    )


# --- the steps ---------------------------------------------------------------------------------------------------------


class _Texts:
    """Texts of a chunk with their sets and signatures."""

    def __init__(self, table: pa.Table, n: int, percent: int):
        self.table, self.ids = table, np.array(table["id"].to_pylist(), np.int64)
        self.sets = shingle_sets(W.string_array(table["text"]), n)
        self.all = signatures(self.sets, percent)
        self.text = self.all.owner[self.all.segment] // 2


def _hashed(n: int):
    def run(batches):
        for batch in batches:
            for at, texts in W.slices(batch["text"]):
                sets = shingle_sets(texts, n)
                text = np.repeat(np.arange(len(texts)), sets.sizes)
                digests = []
                for salt in (8, 9):
                    total = np.zeros(len(texts), np.uint64)
                    np.add.at(total, text, W.mix(sets.hashes, salt))
                    digests.append(total.view(np.int64))
                yield pa.record_batch(
                    {"id": batch["id"].slice(at, len(texts)), "n": pa.array(sets.sizes, pa.int64()), "d1": pa.array(digests[0]), "d2": pa.array(digests[1])}
                )

    return run


def _standing(texts: pa.Table, standing: pa.Table) -> pa.Table:
    """The first row of every id that stands for its class."""
    wanted, rows = set(standing["id"].to_pylist()), []
    for row, i in enumerate(texts["id"].to_pylist()):
        if i in wanted:
            wanted.remove(i)
            rows.append(row)
    return texts.take(pa.array(rows, pa.int64()))


def _count(n: int, percent: int, buckets: int):
    def run(key, texts: pa.Table, standing: pa.Table) -> pa.Table:
        chunk = _Texts(_standing(texts, standing), n, percent)
        return X.Marks(chunk.all.hashes, buckets).packed(key[0].as_py())

    return run


def _keep_unsettled(n: int, percent: int, buckets: int):
    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        is_answer = pa.array(np.array([b is not None for b in told[X.BUCKET].to_pylist()], bool))
        chunk = _Texts(_standing(texts, told.filter(pa.array(~np.array(is_answer)))), n, percent)
        found = chunk.all
        weights = X.Marks(found.hashes, buckets).weights(told.filter(is_answer))
        busy = weights > 0
        full = ~found.empty[found.segment]
        of_text = np.bincount(chunk.text[full], minlength=len(chunk.ids))
        popular = np.bincount(chunk.text[full], weights[full], len(chunk.ids)) / np.maximum(of_text, 1)
        open_sides = ~found.settled(busy)
        keep = np.flatnonzero(open_sides[0::2] | open_sides[1::2])
        useful = busy & full
        order = np.lexsort((found.hashes, chunk.text))
        order = order[useful[order]]
        first = np.searchsorted(chunk.text[order], np.arange(len(chunk.ids) + 1))
        by_text = np.argsort(chunk.text, kind="stable")
        bounds = np.searchsorted(chunk.text[by_text], np.arange(len(chunk.ids) + 1))
        hashes = found.hashes.view(np.int64)
        return pa.table(
            {
                "id": pa.array(chunk.ids[keep], pa.int64()),
                "text": W.string_array(chunk.table["text"]).take(pa.array(keep)).cast(pa.string()),
                "keys": pa.array([hashes[order[first[d] : min(first[d] + KEYS, first[d + 1])]] for d in keep], pa.list_(pa.int64())),
                "popular": pa.array(popular[keep], pa.float64()),
                "busy": pa.array([np.packbits(busy[by_text[bounds[d] : bounds[d + 1]]]).tobytes() for d in keep], pa.binary()),
            }
        )

    return run


def _send_shingles(n: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(W.string_array(table["text"]), n)
        return X.Marks(sets.hashes, buckets).packed(table[X.CHUNK][0].as_py())

    return run


def _enough_shared(n: int, percent: int, buckets: int):
    """Sets of which enough shingles occur in other sets too: a partner holds ``percent`` of them."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        sets = shingle_sets(W.string_array(texts["text"]), n)
        shared = X.Marks(sets.hashes, buckets).answered(told)
        sums = np.concatenate([[0], np.cumsum(shared)])
        held = sums[sets.first[1:]] - sums[sets.first[:-1]]
        kept = texts.select(KEPT_COLUMNS).append_column("held", pa.array(held, pa.int64()))
        return kept.filter(pa.array(100 * held >= percent * sets.sizes))

    return run


def _verify(n: int, percent: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        is_pair = np.array([t is None for t in told["text"].to_pylist()], bool)
        pairs, others = told.filter(pa.array(is_pair)), told.filter(pa.array(~is_pair))
        sets = [shingle_sets(W.string_array(t["text"]), n) for t in (texts, others)]
        at = [{i: d for d, i in enumerate(t.to_pylist())} for t in (texts["id"], others["b"])]
        rows = list(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()))
        good = [(a, b) for a, b in rows if similar(sets[0].of(at[0][a]), sets[1].of(at[1][b]), percent)]
        return pa.table({"a": pa.array([a for a, _ in good], pa.int64()), "b": pa.array([b for _, b in good], pa.int64())})

    return run


def _compare(n: int, percent: int):
    """Of one piece and some probing sets: the links between the two."""

    def run(texts: pa.Table, probing: pa.Table) -> pa.Table:
        ids, others = np.array(texts["id"].to_pylist(), np.int64), np.array(probing["asking"].to_pylist(), np.int64)
        sets, asking = shingle_sets(W.string_array(texts["text"]), n), shingle_sets(W.string_array(probing["asking_text"]), n)
        order = np.argsort(sets.hashes, kind="stable")
        hashes, holder = sets.hashes[order], np.repeat(np.arange(len(ids)), sets.sizes)[order]
        links: list[tuple[int, int]] = []
        for d, other in enumerate(others.tolist()):
            own = asking.of(d)
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            spans = high - low
            at = np.arange(spans.sum()) + np.repeat(low - (np.cumsum(spans) - spans), spans)
            common = np.bincount(holder[at], minlength=len(ids))
            good = (common > 0) & (100 * common >= percent * (len(own) + sets.sizes - common)) & (ids != other)
            links += [(other, int(i)) for i in ids[good]]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _busy(chunk: _Texts) -> np.ndarray:
    """Of each signature whether another set had it in the first count."""
    by_text = np.argsort(chunk.text, kind="stable")
    counts = np.bincount(chunk.text, minlength=len(chunk.ids))
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=c) for b, c in zip(chunk.table["busy"].to_pylist(), counts)]
    busy = np.zeros(len(chunk.text), bool)
    if bits:
        busy[by_text] = np.concatenate(bits).astype(bool)
    return busy


KEPT = "id long, text string, keys array<long>, popular double, busy binary"
KEPT_COLUMNS = [c.split()[0] for c in KEPT.split(", ")]


def _told_of(chunk: _Texts, told: pa.Table, column: str) -> np.ndarray:
    """What ``told`` says in a column about every set of the chunk."""
    known = dict(zip(told["node"].to_pylist(), told[column].to_pylist()))
    return np.array([known[i] for i in chunk.ids.tolist()], np.int64)


LABELLED = f"{X.CHUNK} int, {X.BUCKET} int, marks binary, counts binary, labels binary, mixed binary"


def _send_labels(n: int, percent: int, buckets: int):
    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        chunk = _Texts(texts, n, percent)
        busy = _busy(chunk)
        marks = X.Marks(chunk.all.hashes[busy], buckets)
        labels = _told_of(chunk, told, "root")[chunk.text[busy]][marks.order]
        if not len(labels):
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.schema([(c.split()[0], k) for c, k in zip(LABELLED.split(", "), kinds)]).empty_table()
        low, high = np.minimum.reduceat(labels, marks.heads), np.maximum.reduceat(labels, marks.heads)
        sent, ends = marks.packed(key[0].as_py()), list(zip(marks.begin, marks.end))
        return pa.table(
            {
                X.CHUNK: sent[X.CHUNK],
                X.BUCKET: sent[X.BUCKET],
                "marks": sent["marks"],
                "counts": sent["counts"],
                "labels": pa.array([low[a:b].tobytes() for a, b in ends], pa.binary()),
                "mixed": pa.array([np.packbits((low != high)[a:b]).tobytes() for a, b in ends], pa.binary()),
            }
        )

    return run


def _mixed_weights(table: pa.Table) -> pa.Table:
    """Of one bucket: for each mark 0 if all its holders have one label, else the log weight of their number."""
    parts = [np.frombuffer(m, np.uint32) for m in table["marks"].to_pylist()]
    lengths = np.array([len(p) for p in parts])
    marks, labels = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.int64) for x in table["labels"].to_pylist()])
    order = np.argsort(marks, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = marks[order][1:] != marks[order][:-1]
    heads = np.flatnonzero(new)
    mixed = np.minimum.reduceat(labels[order], heads) != np.maximum.reduceat(labels[order], heads)
    mixed |= np.logical_or.reduceat(X._bits(table["mixed"].to_pylist(), lengths)[order], heads)
    counts = np.concatenate([np.frombuffer(c, np.uint8) for c in table["counts"].to_pylist()])
    held = np.add.reduceat(counts[order].astype(np.int64), heads)
    weights = np.where(mixed, X.log_weight(held), 0).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = weights[np.cumsum(new) - 1]
    ends = np.cumsum(lengths)
    answers = [out[e - c : e].tobytes() for e, c in zip(ends, lengths)]
    return pa.table({X.CHUNK: table[X.CHUNK], X.BUCKET: table[X.BUCKET], "answer": pa.array(answers, pa.binary())})


def _probe(n: int, percent: int, buckets: int):
    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        is_answer = np.array([b is not None for b in told[X.BUCKET].to_pylist()], bool)
        chunk = _Texts(texts, n, percent)
        found, busy = chunk.all, _busy(chunk)
        labels = told.filter(pa.array(~is_answer))
        roots, pieces = _told_of(chunk, labels, "root"), _told_of(chunk, labels, "piece")
        marks = X.Marks(found.hashes[busy], buckets)
        cost = np.zeros(len(found.hashes), np.int64)
        cost[busy] = marks.weights(told.filter(pa.array(is_answer)))
        # an owner that lacks free weight probes its cheapest other segments until it has enough, empty ones last
        heaviest = np.zeros(len(found.owner), np.int64)
        np.maximum.at(heaviest, found.segment, cost)
        heaviest[found.empty & (heaviest > 0)] = 256
        # a partner shares at most the held shingles, so it is not larger than this, and differs by less than need
        held, sizes = np.array(chunk.table["held"].to_pylist(), np.int64), chunk.sets.sizes
        largest = (100 + percent) * held // percent - sizes
        need = np.minimum(found.need, np.repeat((sizes + largest) * (100 - percent) // (100 + percent) + 1, 2))
        lack = need - np.maximum(found.free(cost > 0), np.repeat(sizes - held, 2))
        some = np.flatnonzero((heaviest > 0) & (lack[found.owner] > 0))
        some = some[np.lexsort((heaviest[some], found.owner[some]))]
        total = np.cumsum(found.weight[some])
        owner = found.owner[some]
        lead = np.ones(len(some), bool)
        lead[1:] = owner[1:] != owner[:-1]
        start = (total - found.weight[some])[np.maximum.accumulate(np.where(lead, np.arange(len(some)), 0))] if len(some) else total
        probed = np.zeros(len(found.owner), bool)
        probed[some[total - found.weight[some] - start < lack[owner]]] = True
        rows = np.flatnonzero(cost > 0)
        text = chunk.text[rows]
        return pa.table(
            {
                "signature": pa.array(found.hashes[rows].view(np.int64)),
                "id": pa.array(chunk.ids[text]),
                "root": pa.array(roots[text]),
                "piece": pa.array(pieces[text]),
                "n": pa.array(sizes[text], pa.int64()),
                "held": pa.array(held[text], pa.int64()),
                "probe": pa.array(probed[found.segment[rows]]),
            }
        )

    return run


class _Unsettled:
    """The sets that may have partners: a table of id, text, keys and busy."""

    def __init__(self, table: DataFrame, n: int, percent: int):
        self.table, self.n, self.percent = table, n, percent
        n_bytes = X.text_bytes(table)
        self.chunks, self.buckets = X.chunk_count(n_bytes), X.bucket_count(n_bytes / 5)

    def by_chunk(self, *columns: str):
        return self.table.select(X.chunk_of(self.chunks, "id"), "id", "text", *columns).groupBy(X.CHUNK)

    def narrowed(self) -> _Unsettled:
        """Without the sets whose own shingles alone rule out a partner."""
        mine = self.by_chunk("keys", "popular", "busy")
        sent = self.by_chunk().applyInArrow(_send_shingles(self.n, self.buckets), X.PACKED)
        told = sent.groupBy(X.BUCKET).applyInArrow(X.shared_marks(), X.ANSWER).groupBy(X.CHUNK)
        kept = mine.cogroup(told).applyInArrow(_enough_shared(self.n, self.percent, self.buckets), f"{KEPT}, held long")
        return _Unsettled(write_through(kept, "narrowed"), self.n, self.percent)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that reach the threshold. Each chunk gets the texts of the b it asks for."""
        asked = pairs.select(X.chunk_of(self.chunks, "a"), "a", "b")
        texts = self.table.select(F.col("id").alias("b"), "text")
        wanted = asked.select(X.CHUNK, "b").distinct().join(texts, "b")
        told = asked.withColumn("text", F.lit(None).cast("string")).unionByName(
            wanted.select(X.CHUNK, F.lit(None).cast("long").alias("a"), "b", "text")
        )
        needed = self.table.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        mine = needed.select(X.chunk_of(self.chunks, "id"), "id", "text").groupBy(X.CHUNK)
        return mine.cogroup(told.groupBy(X.CHUNK)).applyInArrow(_verify(self.n, self.percent), "a long, b long")

    def star_pairs(self) -> DataFrame:
        """Each set with the most popular holder of some of its shared signatures: the text that the others of a group
        are copies of shares most of its signatures with most of them."""
        held = self.table.select("id", F.explode("keys").alias("key"), F.struct("popular", (-F.col("id")).alias("less")).alias("rank"))
        best = write_through(held.groupBy("key").agg((-F.max("rank")["less"]).alias("b")), "popular-holders")
        return held.join(best, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()

    def pieces(self, stars: DataFrame, pairs: DataFrame) -> DataFrame:
        """(node, root, piece) of every set. A piece holds up to about ``PIECE`` sets of one component, or of sets
        without links whose popular holders are in the same component; larger ones are dealt by a hash of the id."""
        root_of = stars.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        near = pairs.join(root_of, F.col("b") == F.col("_node"), "left").groupBy("a").agg(F.min(F.coalesce("_root", "b")).alias("near"))
        linked = stars.select("node", "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        linked = write_through(linked, "linked")
        known = self.table.select("id").join(linked, F.col("id") == F.col("node"), "left").join(near, F.col("id") == F.col("a"), "left")
        family = F.coalesce("root", "near", "id").alias("family")
        named = write_through(known.select("id", F.coalesce("root", "id").alias("root"), F.col("node").isNull().alias("single"), family), "families")
        sizes = named.groupBy("family", "single").agg(F.ceil(F.count("*") / PIECE).alias("parts"))
        sizes = write_through(sizes.select(F.col("family").alias("_family"), F.col("single").alias("_single"), "parts"), "family-sizes")
        dealt = named.join(sizes, (F.col("family") == F.col("_family")) & (F.col("single") == F.col("_single")))
        piece = F.xxhash64("family", "single", F.pmod(F.xxhash64("id"), F.col("parts")))
        return write_through(dealt.select(F.col("id").alias("node"), "root", piece.alias("piece")), "pieces")

    def probes(self, pieces: DataFrame) -> DataFrame:
        """(id, piece): the sets that may have links into another component, and the pieces these may lead to."""
        labels = pieces.select(X.chunk_of(self.chunks, "node"), "node", "root", "piece")
        mine = self.by_chunk("busy", "held")
        sent = mine.cogroup(labels.groupBy(X.CHUNK)).applyInArrow(_send_labels(self.n, self.percent, self.buckets), LABELLED)
        answers = sent.groupBy(X.BUCKET).applyInArrow(_mixed_weights, X.ANSWER)
        told = answers.unionByName(labels, allowMissingColumns=True)
        rows = "signature long, id long, root long, piece long, n long, held long, probe boolean"
        held = mine.cogroup(told.groupBy(X.CHUNK)).applyInArrow(_probe(self.n, self.percent, self.buckets), rows)
        held = write_through(held, "holders")
        span = [f(c).alias(f"{name}_{c}") for name, f in (("least", F.min), ("most", F.max)) for c in ("n", "held", "root")]
        groups = write_through(held.groupBy(F.col("signature").alias("_signature"), F.col("piece").alias("_piece")).agg(*span), "holding-pieces")
        # what two sets hold of shared shingles bounds their overlap, which has to reach this part of their sizes
        enough = (100 + self.percent) * F.least("held", "most_held") >= self.percent * (F.col("n") + F.greatest("least_n", F.ceil(F.col("n") * self.percent / 100)))
        fits = (100 * F.col("n") >= self.percent * F.col("least_n")) & (100 * F.col("most_n") >= self.percent * F.col("n"))
        elsewhere = (F.col("least_root") != F.col("root")) | (F.col("most_root") != F.col("root"))
        met = held.where("probe").join(groups, (F.col("signature") == F.col("_signature")) & enough & fits & elsewhere)
        return write_through(met.select("id", F.col("_piece").alias("piece")).distinct(), "probes")

    def found(self, probes: DataFrame, pieces: DataFrame) -> DataFrame:
        """Links (a, b) between the probing sets and the sets of the pieces they probe. A piece that very many sets probe
        is compared with so many of them at a time."""
        turns = probes.groupBy(F.col("piece").alias("_piece")).agg(F.ceil(F.count("*") / PIECE).alias("turns"))
        turns = write_through(turns, "turns")
        texts = self.table.select("id", "text")
        asking = probes.join(turns, F.col("piece") == F.col("_piece")).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")))
        asking = asking.select("piece", "turn", "id").join(texts, "id")
        asking = asking.toDF("asking", "to_piece", "to_turn", "asking_text")
        of_piece = pieces.select(F.col("node").alias("id"), "piece").join(turns, F.col("piece") == F.col("_piece")).join(texts, "id")
        asked = of_piece.select("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "id", "text")
        both = asked.groupBy("piece", "turn").cogroup(asking.groupBy("to_piece", "to_turn"))
        return both.applyInArrow(_compare(self.n, self.percent), "a long, b long")


def similar_documents(
    docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, n_shingles and component_id, the least id reachable over links of Jaccard similarity
    of at least ``threshold`` (whole percent) between shingle sets.

    Words are split at ASCII white space and A-Z lower-cased. Null texts and texts without words have empty sets and no
    links. Ids are integers; rows that repeat an id count as one document with several texts. Rows without an id are
    linked with nothing and keep a null component. Other columns are ignored. An empty table gives no rows.
    """
    percent = round(100 * threshold)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = write_through(source.mapInArrow(_hashed(shingle), "id long, n long, d1 long, d2 long"), "sets")
    equal = hashed.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("stand"))
    classes = write_through(equal, "classes")
    roots = _class_roots(source, classes, shingle, percent)
    found = hashed.join(classes, ["d1", "d2", "n"], "left").join(roots, F.col("stand") == F.col("node"), "left")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "stand", "id")).alias("component_id"),
    )


def _class_roots(source: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root) of the classes that have links."""
    n_bytes = X.text_bytes(source)
    chunks, buckets = X.chunk_count(n_bytes), X.bucket_count(n_bytes / 5)
    standing = classes.select(X.chunk_of(chunks, "stand"), F.col("stand").alias("id")).distinct()
    texts = source.where("id is not null").select(X.chunk_of(chunks, "id"), "id", "text").groupBy(X.CHUNK)
    sent = texts.cogroup(standing.groupBy(X.CHUNK)).applyInArrow(_count(n, percent, buckets), X.PACKED)
    answers = sent.groupBy(X.BUCKET).applyInArrow(X.shared_marks(weighed=True), X.ANSWER)
    told = answers.unionByName(standing, allowMissingColumns=True).groupBy(X.CHUNK)
    unsettled = texts.cogroup(told).applyInArrow(_keep_unsettled(n, percent, buckets), KEPT)
    rest = _Unsettled(write_through(unsettled, "unsettled"), n, percent).narrowed()
    pairs = write_through(rest.star_pairs(), "pairs")
    stars = components(write_through(rest.verified(pairs), "links"), "a", "b")
    pieces = rest.pieces(stars, pairs)
    links = rest.found(rest.probes(pieces), pieces).unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(write_through(links, "links"), "a", "b")
