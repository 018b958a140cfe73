"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node of its component), for every node of ``edges`` (a, b) but the smallest ones.

    Nodes can be of any ordered type. Minima are combined before the shuffle and a node with very many neighbours is
    only ever joined, so it can be split. Each round is stored in the shared folder; the rounds grow with the logarithm
    of the longest path. Self-loops and repeated edges are harmless; no edges give no rows.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        now = tuple(current.agg(F.count("*"), digest).first())
        if now == seen or not now[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        seen = now
        before, current = current, stored(_small_star(_large_star(current)), "edges")
        release(before)
