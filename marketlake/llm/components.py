"""Connected components of a table of edges by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    smaller = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))),
                           F.sum(F.shiftrightunsigned(h, 32))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(u, v)`` but the least of each component, which is the label.

    Both steps keep a minimum for each node, summed before its shuffle, so a node with very many edges is no
    hot key; every round is a table in the shared folder. Null ends and loops are ignored.
    """
    edges = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = None
    while before != (now := _state(edges)) and now[0]:
        before, edges = now, stored(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
