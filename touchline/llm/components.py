"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import durable


def _least(edges: DataFrame, by: str, other: str) -> DataFrame:
    """Every edge with the least of ``by`` and all its ``other`` ends."""
    least = edges.groupBy(by).agg(F.min(other).alias("_m")).withColumn("_m", F.least("_m", by))
    return edges.join(least, by)


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Each node of an edge with the smallest node it reaches: node, root.

    Alternates two steps until the edges no longer change: every node hands its larger neighbours to its least
    one, then every node hands its smaller neighbours to its least one. The number of rounds grows with the
    logarithm of the longest path. Each round is a written table, so lost executors cost one round at most.
    Loops, repeated edges and both directions of an edge are allowed; an empty table gives an empty result.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    edges = durable(edges.select(low.alias("a"), high.alias("b")).where("a < b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both, "a", "b").where("b > a").select(F.col("_m").alias("a"), "b").where("a < b").distinct()
        found = _least(large, "b", "a")
        small = found.select(F.col("_m").alias("a"), "b").unionByName(found.select(F.col("_m").alias("a"), F.col("a").alias("b")))
        edges = durable(small.where("a < b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
