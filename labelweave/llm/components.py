"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _least(pairs: DataFrame) -> DataFrame:
    """The least of each node and its neighbours; stored, so that the join to it can split a hot node."""
    return materialise(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("least")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node links to the least of the node's neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it link to the least of them."""
    joined = edges.join(_least(edges), "u")
    link = F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v"))
    return joined.select(link.alias("u"), F.col("least").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v); the root is the least node of the component.

    Edges stay in stored tables; the driver sees only a count and a checksum each round. Rounds grow
    with the logarithm of the largest component.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    now = materialise(down.distinct(), "edges")
    state = None
    while True:
        now = materialise(_small_star(materialise(_large_star(now), "edges")), "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
