"""Connected components of large graphs by alternating star contractions, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: larger neighbours move to the smallest one. Small: smaller ones do.

    ``edges`` has u > v. The smallest neighbour of each node is a min that combines before the
    shuffle, so a hub with a third of all edges costs a row per task; it joins back on the node.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u2", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("u2"))
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("u2").alias("u"), F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, component`` for every node with an edge, but for those that are their component's smallest.

    ``edges`` has numeric columns u and v in any order; loops don't count. Nothing but one count and
    one checksum a round reaches the driver. Ends when a round changes nothing, after about as many rounds
    as the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    mark = None
    while True:
        now = cut(_star(_star(now, True), False))
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if seen == mark:
            return now.select("u", F.col("v").alias("component"))
        mark = seen
