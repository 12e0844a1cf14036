"""Connected components of an edge list that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates two steps until every node points at its component's smallest node: the larger
    neighbours of a node are hung on its smallest neighbour, then its smaller ones are. No step
    gathers a node's neighbours; a minimum per node is joined back to the edges, and a join
    splits a node with many. Each round is written to the shared folder.
    """
    stars = durable(_directed(edges), "edges")
    known = None
    while True:
        stars = durable(_small_star(_large_star(stars)), "edges")
        sums = stars.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.hash("b").cast("long")).alias("s")).first()
        if sums == known:
            break
        known = sums
    inner = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _directed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(hung.unionByName(least.select("a", F.col("m").alias("b"))))
