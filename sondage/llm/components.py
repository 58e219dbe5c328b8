"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join over the edge table; nothing is collected,
and every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _toward(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node (only the larger / only the smaller ones) to the least of them."""
    if larger_only:
        e = edges.union(edges.select(F.col("b"), F.col("a")))
        least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return e.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    step = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return step.union(least.select("a", F.col("m").alias("b"))).where("a > b")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): every node of a pair with the least node it reaches.

    Pairs of equal ends and repeated pairs add nothing; no pairs give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    last = None
    while True:
        e = _toward(e, larger_only=True).distinct()
        e = written(_toward(e, larger_only=False).distinct(), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
