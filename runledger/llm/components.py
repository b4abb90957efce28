"""Connected components of links, by alternating star contraction on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and all neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    linked = down.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that an edge ``(a, b)`` touches; the root is its smallest.

    Nodes are longs; edges that are null or loops are left out. Every round writes its edges
    to the shared folder; rounds grow with the logarithm of the longest chain. Only the
    number and a checksum of the edges come to the driver.
    """
    state, seen = cut(edges.filter("a <> b").select("a", "b").distinct(), "links"), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        state = cut(_small_star(_large_star(state)), "links", replaces=state)
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
