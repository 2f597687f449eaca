"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.hot import join_facts
from siteloom.sources.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge (a, b), the smallest node that links reach.

    Each step replaces edges by edges to the smallest neighbour, so the graph never grows; hot nodes are aggregated
    before the shuffle and meet their edges in several places, and every round is written to the shared folder. It ends
    when a round changes nothing, after a number of rounds that grows with the logarithm of the longest path.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (state := _state(edges)) != before:
        before = state
        larger = written(_large_star(edges, state[0]), "links")
        edges = written(_small_star(larger, state[0]), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = written(least.select("a", F.least("a", "m").alias("m"), "n"), "least")
    return join_facts(both.where("b > a"), least, "a", "n", total, F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node's smaller neighbours, and the node, to the smallest of them."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    moved = join_facts(edges, least, "a", "n", total, F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).where("a <> b").distinct()


class Forest:
    """Union-find over the rows of one block: keeps only links that connect something new."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def roots(self) -> np.ndarray:
        """The root of every row, with all paths shortened."""
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return up
            self.root = up

    def join(self, a: int, b: int) -> bool:
        """Connect two rows; whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True
