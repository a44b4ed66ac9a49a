"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.session import durable


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(low, "a").where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Rows hold a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node it reaches.

    ``edges`` holds pairs (a, b) in either order; loops and nulls are ignored. A round writes its
    edges to the shared scratch folder, so a lost executor costs one round. The number of rounds
    grows with the logarithm of the longest path; a hub costs two aggregations and splittable joins.
    """
    now = durable(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), name,
    )
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark.n == 0 or (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
        now = durable(_small(_large(now)), name)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
