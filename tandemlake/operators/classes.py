"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard, release


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge to another.

    edges: a, b (comparable, not null). Repeated edges, loops and both directions are fine. Each round is written to
    the shared checkpoint folder. Per node only the smallest neighbour is gathered, by partial sums, and what is
    joined back to it can be split where a node has many neighbours; rounds grow with the logarithm of the nodes.
    """
    pairs = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, written = _mark(pairs), pairs
    while mark[0]:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Every larger neighbour of a node is tied to the smallest one.
        pairs = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every node and its smaller neighbours are tied to the smallest one.
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        ties = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        pairs = cut(ties.filter("a <> b").distinct())
        discard(written)
        written = pairs
        before, mark = mark, _mark(pairs)
        release(pairs.sparkSession)
        if mark == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
