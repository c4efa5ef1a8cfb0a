"""Connected components of an edge table by alternating star contraction.

Each round is a fixed number of joins and grouped minima over the edges (no
neighbour lists are collected, so a hub is only a hot join key, which adaptive
execution splits).  Rounds are written to the shared folder; the edge set
converges to one star per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import stored


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _clean(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _clean(moved.unionByName(low.select("a", F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns ``a``, ``b``).

    ``root`` is the smallest node of the component.
    """
    now = stored(_clean(edges), "edges")
    state = _state(now)
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
