"""Connected components by alternating large-star and small-star steps, each a join and an aggregate over written edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the smallest node that can be reached.

    Rounds grow with the logarithm of the longest chain.  A node of very many edges meets its least neighbour in a
    plain join, which may be split where it is uneven; its neighbours are never gathered.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Large star: every larger neighbour is tied to the least node around.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "node")
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "edges")
        # Small star: a node and its smaller neighbours are tied to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = materialize(small.union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = now
