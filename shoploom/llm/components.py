"""Connected components with DataFrame operations only.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014). Every step is a grouped
minimum, which combines before the shuffle, and a join of edges to one minimum
per node. The minima are dealt out afresh before that join, so both of its sides
are plain shuffles and adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _linked(edges: DataFrame, lowest: Column) -> DataFrame:
    """Edges (node, other) beside the minimum of each node's neighbours, itself included."""
    mins = edges.groupBy("node").agg(F.min("other").alias("m")).select("node", lowest.alias("m"))
    return edges.join(mins.repartition("node", "m"), "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    linked = _linked(both, F.least("node", "m")).where("other > node")
    return linked.select(F.col("other").alias("node"), F.col("m").alias("other")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _linked(edges, F.col("m"))
    moved = linked.where("other <> m").select(F.col("other").alias("node"), F.col("m").alias("other"))
    return moved.unionAll(edges.groupBy("node").agg(F.min("other").alias("other"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")).alias("x"),
        ).first()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Maps each node on an edge to the smallest node it can reach.

    Returns (node, component). Loops and edges with a null end add nothing; an
    empty input gives an empty result. Nodes may be of any ordered type.
    """
    now = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
        .distinct()
    )
    before, mark = None, _fingerprint(now)
    while mark != before and mark[0]:
        now = cut(_small_star(_large_star(now)))
        before, mark = mark, _fingerprint(now)
    # every edge now leads from a node to the root of its star
    members = now.select("node", F.col("other").alias("component"))
    return members.unionAll(now.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct())
