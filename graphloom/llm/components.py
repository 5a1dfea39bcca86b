"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """node, root from node, root where roots are smaller nodes: each jump halves the paths."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = materialize(parents.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "cc-jump")
        parents = jumped.select("node", "root")
        if not jumped.where("_moved").limit(1).count():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b) but the roots themselves.

    Each round lets every node point at its smallest smaller neighbour, follows the pointers to their ends and keeps the
    edges between different ends, once each. A node with a smaller neighbour ends in a round, so rounds are few; a hub
    is one row after partial aggregation, and its joins may be split by the adaptive skew join.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    out = None
    while edges.limit(1).count():
        roots = _roots(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        if out is None:
            out = roots
        else:
            last = roots.select(F.col("node").alias("root"), F.col("root").alias("_last"))
            out = materialize(out.join(last, "root", "left").select("node", F.coalesce("_last", "root").alias("root")).unionByName(roots), "cc-roots")
        ends = roots
        for side in ("a", "b"):
            of = ends.select(F.col("node").alias(side), F.col("root").alias("_r"))
            edges = edges.join(of, side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
        edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out
