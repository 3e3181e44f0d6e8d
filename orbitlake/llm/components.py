"""Connected components as a distributed union-find: large stars and small stars until every edge points at its root.

Every round is written to the shared folder, so a lost executor costs a read, not a recomputation, and plans stay
short. The minimum of each node is written before it is joined back: then Spark sees a plain join and can split a
node that holds a third of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.workspace import write_through


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node next to u, u itself included."""
    least = write_through(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    least = least.select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    stars = _with_least(edges)
    onward = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(stars.select("u", F.col("m").alias("v"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: then each component is one star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return each.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links`` that is not the least of its component; root is the least node.

    Self links and nulls are ignored, repeated links count once; no links give an empty table.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = write_through(edges, "edges")
    while not _is_settled(edges):
        edges = write_through(_large_star(edges).distinct(), "edges")
        edges = write_through(_small_star(edges), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
