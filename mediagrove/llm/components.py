"""Connected components of links by alternating stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, release


def _stars(edges: DataFrame) -> bool:
    """Whether each node either points at one node that points nowhere, or only is pointed at."""
    ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("out"), F.lit(0).alias("inside")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("w").agg(F.sum("out").alias("out"), F.sum("inside").alias("inside"))
    return per.where("out > 1 or (out > 0 and inside > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, label: the least id reachable) for every id of ``links`` (a, b). Self links keep their ids.

    Each round points every node's larger neighbours at its least neighbour, then its smaller ones; the number of rounds
    grows with the logarithm of the longest path, and links that are stars already need none. Hot nodes are aggregated before they are shuffled,
    and joined, not collected.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges, last = cut(small), edges
        release(last, large)
    labels = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
