"""Connected components of an edge table, by alternating large-star and small-star steps.

A node's smallest neighbour comes from an aggregate with partial minima and goes back to its edges in parts, so a node
with very many edges is no single task. Each round is written to the shared folder; nothing is gathered on the driver
but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import cut, join_hot

#: More rounds than any input takes: they grow with the logarithm of the longest path.
ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest v of each u."""
    return join_hot(edges, edges.groupBy("u").agg(F.min("v").alias("m")), "u", F.col("v"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u long, v long); root is the smallest node reachable.

    Edges have no direction; repeated edges and loops change nothing, a null on either side is no edge, and an empty
    table gives an empty one.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(e)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        lower = _with_least(large)
        e = cut(lower.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
