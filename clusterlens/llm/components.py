"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a minimum per node (combined before its shuffle) joined back to the edges; nothing is gathered per node
or on the driver, which only compares one count and checksum per round. The rounds needed grow with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.common import settle, spread_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where(F.col("b") > F.col("a"))
    return spread_join(larger, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; ``a > b`` in all edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(edges, least, "a").where(F.col("b") > F.col("m"))
    return least.select("a", F.col("m").alias("b")).unionByName(
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of BIGINT edges ``a``, ``b`` but the roots.

    Loops, repeated edges and both directions are allowed; edges with a NULL end are ignored. No edges, no rows.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    stars = settle(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _signature(stars)
    while now != before:
        stars = settle(_small_star(_large_star(stars)))
        before, now = now, _signature(stars)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
