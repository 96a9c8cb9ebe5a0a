"""Connected components by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribemill.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def component_labels(links: DataFrame, label: str = "component") -> DataFrame:
    """Columns ``node`` and ``label`` for every node that is larger than the smallest node of its component.

    ``links`` has long columns a and b. Each round stages the edges, so a lost
    executor costs one round; the number of rounds grows with the logarithm of
    the longest path. Minima are formed before rows move, so a node with very many links is no hot spot.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).alias("mark")
    seen = edges.agg(mark).first()[0]
    while True:
        edges = stage(_small_star(_large_star(edges).distinct()), "stars")
        now = edges.agg(mark).first()[0]
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias(label))
        seen = now
