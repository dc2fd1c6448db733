"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every node that ``links`` (undirected) joins to another.

    Each round hangs nodes on the smallest neighbour, by an aggregate with
    partial sums and a join, so that a hub's neighbours never meet in one
    place; the rounds are logarithmic in the nodes and each is written to the
    shared folder. Only counts reach the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = materialise(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        before = edges
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = materialise(small.select("e.u", F.col("e.m").alias("v")).where("u != v").distinct(), "small_star")
        discard(before, large)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return star.union(star.select("label", "label").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
