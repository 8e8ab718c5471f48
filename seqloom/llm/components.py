"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame) -> DataFrame:
    """v, component (smallest v reachable) for every end of links(a, b), longs. Self links and repeats are allowed.

    In a large star every larger neighbour of a vertex is linked with the smallest of its neighbourhood, in a small star
    every other one is; the two in turn end in stars. Each round is written to the shared folder, so its plan stays small.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
