"""Connected components of an edge list by alternating large and small stars, a few shuffles over edges a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.llm.shared import materialize, spread_join


def with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): each edge with the least of ``a`` and of all its partners; the edges of a hub are dealt to several tasks."""
    ends = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "ends")
    return spread_join(edges, ends, ["a"], "b").select("a", "b", F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b: long); the root is the least node of the component."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Large star: the larger neighbours of each node go to the least of it and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: each node and its smaller neighbours go to the least of them.
        edges = materialize(edges, "large")
        edges = with_least(edges).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = materialize(edges, "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
