"""Connected components of an edge table by alternating star contractions.

Each round links every node to the smallest node around it (large star), then
every smaller neighbour to the smallest (small star); the number of rounds
grows with the logarithm of the longest chain. Only grouped minima and joins
are used; every round is written in the shared folder, and only one row (a
checksum that tells when nothing changes any more) reaches the driver.

Edge cases: an edge with a null end is no edge; loops and repeated edges change
nothing; a node without an edge to another node has no row; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: ``u, v`` (any order, loops and repeats allowed). Returns
    ``node, root`` for every node with an edge to another node, where root is
    the smallest node of its component."""
    edges = written(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        linked = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(linked.unionByName(
            least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
