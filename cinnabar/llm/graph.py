"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import discard, materialize


def is_star(edges: DataFrame) -> bool:
    """Whether every node hangs from one root and no root hangs from another node."""
    twice = edges.groupBy("a").count().where("count > 1").limit(1).count()
    if twice:
        return False
    return not edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").limit(1).count()


def roots(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(a, b): every node of the edges (a, b), a > b, that isn't its component's smallest, and that smallest.

    Large-star and small-star steps in turn until each component is a star; they take about log2 of the longest
    path, and every step is written, so that lost executors cost little.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), name)
    while not is_star(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = materialize(small.where("a <> b").distinct(), name)
        discard(large)
        discard(now)
        now = new
    return now
