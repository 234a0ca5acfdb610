"""Connected components of an edge table by alternating large-star and small-star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: two long columns a, b.

    Every step is a minimum per node and a join back to the edges, so that a node with very many
    neighbours never has them gathered in one place. Each round is written to the shared folder, and so is the
    result, which the caller may drop.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, now = now, written(small, "edges")
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(last)
        if tuple(stats) == mark:
            found = written(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
            drop_written(now)
            return found
        mark = tuple(stats)
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
