"""Exact top-k inner products by ball trees.

Vectors are dealt to shards; each shard becomes one ball tree, kept as numpy arrays in a row of a written table.
Queries are met in blocks. A grid deals groups of trees and parts of the queries to cells, a cell a task, so that the
number of tasks follows the work and not shards times blocks. A first pass looks only into the most promising leaf of
every tree; the k-th best of what it finds bounds the answer from below and is shared with all cells. The second pass
visits nodes in the order of the upper bound q·c + |q| r of their ball, for the queries of a block at once, and leaves
out the queries whose bound falls below the k-th score known so far.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake.workspace import write_through

SHARD_ROWS = 8192
SHARD_BYTES = 1 << 22  # of a shard's vectors; long ones make shards of fewer rows
LEAF_ROWS = 128
BLOCK_QUERIES = 2048
TASK_PAIRS = 1 << 33  # of a vector and a query, for a task of the second pass
FIRST_PASS = 16  # times as many for a task of the first pass, which looks into one leaf of a tree
TASK_BYTES = 1 << 26  # of the queries that a task holds; trees come one at a time
MOST_TASKS = 4096  # of a pass, unless the queries take more
TREE = "_shard int, kind string, ids binary, vectors binary, centers binary, radii binary, bounds binary, children binary"


def _matrix(table: pa.Table) -> np.ndarray:
    return pc.list_flatten(table["vector"]).to_numpy().reshape(len(table), -1)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in fewer bytes, where they fit."""
    if np.abs(vectors).max() < 1 << 15 and (vectors == np.rint(vectors)).all():
        return vectors.astype(np.int16)
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return single if (single == vectors).all() else vectors


def _packed(arrays: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    return {name: pa.array([x.tobytes()], pa.binary()) for name, x in arrays.items()}


def _build(leaf: int):
    """A shard's ball tree: points ordered so that every node holds a run of them."""

    def run(table: pa.Table) -> pa.Table:
        ids, points = table["id"].to_numpy(), _matrix(table)
        order = np.lexsort((ids,))
        centers, radii, bounds, children = [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = points[order[a:b]]
            center = own.mean(axis=0)
            away = np.sqrt(((own - center) ** 2).sum(axis=1))
            node = len(radii)
            centers.append(center)
            radii.append(away.max() * (1 + 1e-9) + 1e-6)
            bounds.append((a, b))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][0 if children[parent][0] < 0 else 1] = node
            if b - a > leaf and away.max() > 0:
                one = own[np.argmax(away)]
                two = own[np.argmax(((own - one) ** 2).sum(axis=1))]
                side = own @ (one - two)
                half = (b - a) // 2  # halves of equal size, so that equal vectors cannot make a long chain
                order[a:b] = order[a:b][np.argsort(side, kind="stable")]
                stack += [(a, a + half, node), (a + half, b, node)]
        vectors = _narrow(points[order])
        nodes = {"centers": np.array(centers), "radii": np.array(radii), "bounds": np.array(bounds, np.int64), "children": np.array(children, np.int64)}
        head = {"_shard": pa.array([table["_shard"][0].as_py()], pa.int32()), "kind": pa.array([vectors.dtype.str])}
        return pa.table(head | _packed({"ids": ids[order], "vectors": vectors} | nodes))

    return run


class _Tree:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.points = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), -1)
        self.radii = np.frombuffer(row["radii"], np.float64)
        self.centers = np.frombuffer(row["centers"], np.float64).reshape(len(self.radii), -1)
        self.bounds = np.frombuffer(row["bounds"], np.int64).reshape(-1, 2).tolist()
        self.children = np.frombuffer(row["children"], np.int64).reshape(-1, 2)
        self.leaves = np.flatnonzero(self.children[:, 0] < 0)
        self.most = float(np.abs(self.points.astype(np.float64)).max())
        self._as: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.points.astype(kind)
        return self._as[kind]


class _Block:
    """Queries and the best ``k`` that each has met, but of those at least ``least`` only."""

    def __init__(self, row: dict, k: int):
        self.k, self.ids = k, np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), -1)
        wide = self.vectors.astype(np.float64)
        self.lengths, self.most = np.sqrt((wide**2).sum(axis=1)), float(np.abs(wide).max())
        self.least = np.frombuffer(row["least"], np.float64).copy()
        self.last = np.full(len(self.ids), np.iinfo(np.int64).max)  # largest id that counts at a score of ``least``
        self.count = np.zeros(len(self.ids), np.int64)
        self.scores, self.found = np.zeros((len(self.ids), k)), np.zeros((len(self.ids), k), np.int64)

    def search(self, tree: _Tree, first_leaf: bool) -> None:
        """``first_leaf``: of each query's best leaf only, and scores less what rounding may add to them."""
        wide, dim = self.vectors.astype(np.float64), self.vectors.shape[1]
        rows = np.flatnonzero(~(wide @ tree.centers[0] + self.lengths * tree.radii[0] < self.least))
        if not len(rows):
            return
        # sums of integers this small are exact in any order, so half the width does
        whole = self.vectors.dtype.kind == "i" and tree.points.dtype.kind == "i"
        kind = np.float32 if whole and dim * self.most * tree.most < 1 << 24 else np.float64
        points, queries = tree.of(kind), self.vectors[rows].astype(kind)
        upper = tree.centers @ wide[rows].T + tree.radii[:, None] * self.lengths[rows]
        if first_leaf:
            slack = 0.0 if whole else dim * math.sqrt(dim) * tree.most * self.lengths * 2.0**-51
            own = tree.leaves[np.argmax(upper[tree.leaves], axis=0)]
            for node in np.unique(own).tolist():
                near = own == node
                self._look(tree, node, rows[near], points, queries[near], slack)
            return
        queue = [(-upper[0].max(), 0)]
        while queue:
            _, node = heapq.heappop(queue)
            near = ~(upper[node] < self.least[rows])
            if not near.any():
                continue
            if tree.children[node, 0] >= 0:
                for child in tree.children[node].tolist():
                    heapq.heappush(queue, (-upper[child].max(), child))
            elif near.all():
                self._look(tree, node, rows, points, queries)
            else:
                self._look(tree, node, rows[near], points, queries[near])

    def _look(self, tree: _Tree, node: int, rows: np.ndarray, points: np.ndarray, queries: np.ndarray, slack: np.ndarray | float = 0.0) -> None:
        """Take what the points of a leaf add to the best of ``rows``."""
        a, b = tree.bounds[node]
        ids, least, last = tree.ids[a:b], self.least[rows], self.last[rows]
        scores = points[a:b] @ queries.T
        top = scores.max(axis=0)
        hit = ~((top < least) | ((top == least) & (ids.min() > last)))
        if not hit.any():
            return
        rows, scores, least, last = rows[hit], scores[:, hit], least[hit], last[hit]
        better = (scores > least) | ((scores == least) & (ids[:, None] <= last))
        better &= ids[:, None] != self.ids[rows]
        at, row = np.nonzero(better)
        if len(at):
            told = scores[at, row].astype(np.float64)
            self._merge(rows, row, told - (slack if np.isscalar(slack) else slack[rows[row]]), ids[at])

    def _merge(self, rows: np.ndarray, row: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        held, place = np.nonzero(np.arange(self.k) < self.count[rows][:, None])
        row = np.concatenate([held, row])
        score = np.concatenate([self.scores[rows[held], place], score])
        vec = np.concatenate([self.found[rows[held], place], vec])
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        fresh = np.append(True, (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (vec[1:] != vec[:-1]))
        row, score, vec = row[fresh], score[fresh], vec[fresh]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        row, score, vec, rank = row[kept], score[kept], vec[kept], rank[kept]
        self.scores[rows[row], rank], self.found[rows[row], rank] = score, vec
        self.count[rows] = np.bincount(row, minlength=len(rows))
        full = rows[self.count[rows] == self.k]
        self.least[full], self.last[full] = self.scores[full, -1], self.found[full, -1]

    def answer(self, first_leaf: bool) -> pa.RecordBatch:
        """(query_id, vec_id, score), each once; ``first_leaf``: each pair of ids once."""
        row, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        query, vec, score = self.ids[row], self.found[row, place], self.scores[row, place]
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        fresh = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
        fresh = np.append(True, fresh if first_leaf else fresh | (score[1:] != score[:-1]))[: len(query)]
        return pa.record_batch({"query_id": query[fresh], "vec_id": vec[fresh], "score": score[fresh]})


def _search(k: int, first_leaf: bool):
    """Over the rows of cells, in each the blocks of queries before the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[0].as_py() for name, column in zip(batch.schema.names, batch.slice(i, 1).columns)}
                if row["_cell"] != cell:
                    yield from (block.answer(first_leaf) for block in blocks)
                    cell, blocks = row["_cell"], []
                if row["_turn"] == 0:
                    blocks.append(_Block(row, k))
                    continue
                tree = _Tree(row)
                for block in blocks:
                    block.search(tree, first_leaf)
        yield from (block.answer(first_leaf) for block in blocks)

    return run


def _blocked(table: pa.Table) -> pa.Table:
    rows = table.sort_by("id")
    vectors = _narrow(_matrix(rows))
    least = pc.fill_null(rows["least"], -math.inf).to_numpy()
    head = {"_block": pa.array([rows["_block"][0].as_py()], pa.int32()), "kind": pa.array([vectors.dtype.str])}
    return pa.table(head | _packed({"ids": rows["id"].to_numpy(), "vectors": vectors, "least": least}))


def _grid(shards: int, blocks: int, points: int, asked: int, dim: int, pairs: int, at_least: int) -> tuple[int, int]:
    """Groups of shards and parts of blocks, whose cells are the tasks of a pass: as many as the pairs take, in the shape
    that copies least (the trees go to every part, the queries to every group), and parts that fit a task."""
    tasks = min(MOST_TASKS, max(at_least, math.ceil(points * asked / pairs)))
    fitting = math.ceil(8 * dim * asked / TASK_BYTES)
    parts = min(blocks, max(1, fitting, round(math.sqrt(tasks * asked / points)), math.ceil(tasks / shards)))
    return min(shards, math.ceil(tasks / parts)), parts


FOUND = "query_id long, vec_id long, score double"


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors of largest inner product with every query, itself (the row of the same id) left out: query_id,
    rank from 1, vec_id, score; ties to the smaller vec_id. Fewer candidates give fewer rows.

    Vectors that are null or hold null, NaN or infinite components take no part on either side, nor do null ids and
    vectors of another length than the most common one. A repeated id with the same vector counts once. Products are
    exact where components are integers and sums stay below 2**53. Other columns are ignored.
    """
    spark = vectors.sparkSession
    points, asked = (_clean(df, id_col, vector_col) for df in (vectors, queries))
    points = write_through(points, "vectors")
    sizes = points.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = F.size("vector") == sizes.dim
    shards = max(1, math.ceil(sizes.n / max(LEAF_ROWS, min(SHARD_ROWS, SHARD_BYTES // (8 * sizes.dim)))))
    # a query and a vector of the same id go the same way, whatever their vectors
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("_shard")
    trees = write_through(points.where(same).select(shard, "id", "vector").groupBy("_shard").applyInArrow(_build(LEAF_ROWS), TREE), "trees")
    asked = write_through(asked.where(same), "queries")
    count = asked.count()
    blocks = max(1, math.ceil(count / BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("_block")

    def pass_over(rows: DataFrame, first_leaf: bool) -> DataFrame:
        pairs = TASK_PAIRS * (FIRST_PASS if first_leaf else 1)
        groups, parts = _grid(shards, blocks, sizes.n, count, sizes.dim, pairs, spark.sparkContext.defaultParallelism)

        def cell(group: Column, part: Column, turn: int) -> list[Column]:
            return [(group * parts + part).cast("int").alias("_cell"), F.lit(turn).alias("_turn")]

        packed = rows.groupBy("_block").applyInArrow(_blocked, "_block int, kind string, ids binary, vectors binary, least binary")
        everywhere = packed.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        met = trees.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        work = everywhere.select(*cell(F.col("_group"), F.col("_block") % parts, 0), "*").drop("_block", "_group")
        work = work.unionByName(met.select(*cell(F.col("_shard") % groups, F.col("_part"), 1), "*").drop("_shard", "_part"), allowMissingColumns=True)
        dealt = work.repartitionById(groups * parts, F.col("_cell")).sortWithinPartitions("_cell", "_turn")
        return dealt.mapInArrow(_search(k, first_leaf), FOUND)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = pass_over(asked.select(block, "id", "vector", F.lit(None).cast("double").alias("least")), True)
    kth = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    bounded = asked.join(write_through(kth, "kth"), "id", "left").select(block, "id", "vector", "least")
    found = pass_over(bounded, False)
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, vector of doubles) whose components all are numbers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    usual = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(usual).dropDuplicates(["id", "vector"])
