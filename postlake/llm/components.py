"""Connected components of a graph given as pairs, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.frames import written


def _down(edges: DataFrame) -> DataFrame:
    """Each pair once, from the larger end to the smaller."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = both.filter("v > u").join(least, "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one type) that is not itself
    the smallest node of its component.

    Alternates two local steps until nothing changes; the rounds grow with the logarithm of
    the number of nodes.  Each round is written to the shared folder.
    """
    edges = written(_down(edges.toDF("a", "b")), "edges")
    state = _state(edges)
    while state[0]:
        edges = written(_down(_small_star(_down(_large_star(edges)))), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.toDF("node", "root")
