"""Connected components of an edge table, with star contraction (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The rounds grow with the logarithm of the number of nodes; so many are never needed.
MAX_ROUNDS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of its component) of every node that some edge (u, v) joins to another one.

    u and v may be of any one orderable type. Edges with a null end and loops are ignored. Minima are taken before the shuffle,
    and a node's list of neighbours is never gathered, so a node with very many edges is no larger work for any task than
    its share of the rows: the join that follows is one that Spark splits when it is skewed.
    """
    u, v = F.col("u"), F.col("v")
    now = cut(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(u.alias("w"), F.least("m", u).alias("m"))
        large = both.join(least, u == F.col("w")).filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = large.join(least, u == F.col("w"))
        # A node's lesser neighbours and itself go to the least of them.
        small = joined.filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        now = cut(small)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("star contraction did not come to rest")
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
