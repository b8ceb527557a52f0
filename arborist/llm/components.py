"""Connected components by alternating large-star and small-star contractions.

Each round is two aggregations by key with map-side minima and two equality joins by sorting (edges compress
well: by the size of their files they would be broadcast through the driver), so a hub's rows may be split
(adaptive skew joins) and no component is ever gathered in one place. Rounds grow with
the logarithm of the graph; each is written to shared storage, the one before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(e: DataFrame) -> DataFrame:
    """Every node hands the smallest of its surroundings to its larger neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the smallest of them."""
    low = _minimum(e)
    tied = e.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Loops, repeated edges and edges with a null end are left out; no edges give an empty result.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        after = stored(_small(_large(e)), "edges")
        now = _mark(after)
        forget(e)
        e = after
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
