"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node near: all larger ones (large) or all others from smaller ones (small)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): the least node of each linked node's component. links: (a, b). No row for nodes without links."""
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    for _ in range(most):
        before, edges = edges, materialize(star(star(edges, True), False), "stars")
        discard(before)
        # Done when no node hangs on two others and no node that hangs has others hanging on it.
        roots = edges.select(F.col("b").alias("a")).distinct()
        if edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).join(roots.withColumn("root", F.lit(True)), "a", "left").filter("lo <> hi OR root").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
