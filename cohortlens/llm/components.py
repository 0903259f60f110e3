"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations with joins; nothing but a change count reaches
the driver, and rounds are cut through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select(F.explode(F.array(F.struct("u", "v"), back)).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of u to the least of u and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins u and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array("v", "u")).alias("u")
    return down.join(least, "u").select(ends, F.col("m").alias("v")).where("u <> v")


def components(links: DataFrame) -> DataFrame:
    """node, comp: for every end of a link (columns u, v) the least node of its component."""
    edges = cut(links.select("u", "v").where("u <> v").distinct(), "links")
    seen = None
    while True:
        # each star is a small plan of its own: the driver keeps every plan, and plans anew after each of its shuffles
        edges = cut(_large_star(edges), "large-stars")
        edges = cut(_small_star(edges).distinct(), "stars")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
