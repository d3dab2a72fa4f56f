"""Connected components of an undirected edge table, by alternating large and small stars.

Every round maps each node to the smallest node it knows of.  A hub's neighbours are combined by
partial aggregation and its edges are told its minimum by a join, which may split a hot hub, so no
task holds a whole component.  The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on distinct edges ``a > b``."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        joined = both.join(least, "a").withColumn("m", F.least("a", "m")).where("b > a")
        # repeated edges fold in the small star that follows
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    joined = both.join(least, "a")
    return joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node of its component) for every node of ``edges(a, b)``.

    Nodes are comparable and not null; self-loops and repeated edges don't matter.  Nodes without
    an edge to another node are absent: they are their own component.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = written(e, "cc-edges")
    before = None
    for _ in range(max_rounds):
        e = written(_star(_star(e, large=True), large=False), "cc-round")
        # both stars keep the node set; once nothing changes, every edge points to its component's minimum
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")
