"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the undirected ``edges`` (a, b): root is the smallest node reachable.

    Alternates large and small stars: every node hands the smallest node that it
    knows to its larger (then to its smaller) neighbours until each component is
    a star.  Minima are aggregated partially and written before they are joined
    back, so a hub's many edges are a skewed join side that Spark splits.
    Self-loops and repeated edges are harmless; without edges there are no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = stage(edges, "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large-minima")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large.filter("a != b"), "large-star")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "small-minima")
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(least).distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    if edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
        return False  # somebody's root has a root
    n = edges.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
    return n[0] == n[1]
