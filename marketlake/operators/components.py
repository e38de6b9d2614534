"""Connected components of a graph, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.session import stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these. Edges go from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return _distinct(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (u, v; bigint) but the least of its component, which is the label.

    The minimum of a node's neighbours is combined before its shuffle, so a node with very many edges is no hot key there;
    joins leave skew to adaptive execution. A round is one table in the scratch folder; there are about as many rounds as
    the logarithm of the longest path.
    """
    now, before = stored(_distinct(edges.select("u", "v")), "edges"), None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = mark
