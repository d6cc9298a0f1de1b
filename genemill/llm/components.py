"""Connected components of an edge list, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (columns a, b) can reach.

    Every round links the neighbours of a node to its smallest neighbour, first those above the node, then those
    below, until nothing changes; paths shorten by half or more. A node with very many neighbours is summed before it
    is shuffled, and its join is split by AQE. Each round is written to the checkpoint folder, so a lost executor
    costs one round.
    """
    now = cut(_tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    state = _state(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            # stars: every edge goes from a node to the smallest of its component
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        state = after


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node go to the smallest of the node and its neighbours. Edges are (larger a, smaller b)."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    up = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u", "left")
    return _tidy(up.select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below go to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return _tidy(down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own))
