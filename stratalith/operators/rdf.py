"""Radial distribution functions and distances between distributions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import smooth_cutoff


def rdf(edges: DataFrame, key: str, high: float, bins: int, channel: str | None = None, per: str | None = None) -> DataFrame:
    """(key, channel, bin, value): counts over the shell's volume, faded over the last unit. ``r`` is the bin's right edge.

    per: a column of ``edges`` to divide by, constant in a group (molecules in the asymmetric unit).
    """
    w = high / bins
    rows = edges.filter((F.col("dist") >= 0) & (F.col("dist") < high)).withColumn("bin", F.floor(F.col("dist") / w).cast("int"))
    rows = rows.withColumn("channel", F.col(channel) if channel else F.lit("all")).filter("channel IS NOT NULL")
    n = rows.groupBy(key, "channel", "bin").agg(F.count(F.lit(1)).alias("n"), (F.first(per) if per else F.lit(1)).alias("per"))
    r = F.col("bin") * w
    shell = 4 / 3 * math.pi * (F.pow(r + w, 3) - F.pow(r, 3))
    return n.select(key, "channel", "bin", (r + w).alias("r"), (F.col("n") / shell * smooth_cutoff(r + w, high, high - 1) / F.col("per")).alias("value"))


def normalised(hist: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Bins as shares of their group (1e-10 added to the sum)."""
    return hist.withColumn("p", F.col(value) / (F.sum(value).over(Window.partitionBy(*keys)) + 1e-10))


def cdf(hist: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    return hist.withColumn("cdf", F.sum(p).over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def dense_bins(hist: DataFrame, keys: list[str], bins: int, value: str = "value") -> DataFrame:
    """Every bin of every group, 0 where there was none."""
    grid = hist.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(hist.select(*keys, "bin", value), [*keys, "bin"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def emd_pairs(hist: DataFrame, key: str, bins: int, pairs: DataFrame | None = None, width: float = 1.0, value: str = "value") -> DataFrame:
    """(a, b, emd): sum of CDF differences times the bin width, for the pairs given or all a < b of a bounded set of groups."""
    c = cdf(normalised(dense_bins(hist, [key], bins, value), [key], value), [key])
    a, b = (c.select(F.col(key).alias(s), "bin", F.col("cdf").alias(f"c{s}")) for s in "ab")
    met = a.join(pairs, "a").join(b, ["b", "bin"]) if pairs is not None else a.join(b, "bin").filter("a < b")
    return met.groupBy("a", "b").agg((F.sum(F.abs(F.col("ca") - F.col("cb"))) * width).alias("emd"))


def rdf_distance(values: DataFrame, key: str, bins: int, width: float, pairs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(a, b, distance): mean over the channels active in either of the EMD of normalised channels."""
    c = cdf(normalised(dense_bins(values, [key, "channel"], bins), [key, "channel"]), [key, "channel"])
    sides = [pairs.join(c.select(F.col(key).alias(s), "channel", "bin", F.col("cdf").alias("cdf")), s).select("a", "b", "channel", "bin", F.lit(s).alias("side"), "cdf") for s in "ab"]
    both = sides[0].unionByName(sides[1]).groupBy("a", "b", "channel", "bin").agg(F.abs(F.sum(F.when(F.col("side") == "a", F.col("cdf")).otherwise(-F.col("cdf")))).alias("gap"))
    emd = both.groupBy("a", "b", "channel").agg((F.sum("gap") * width).alias("emd"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, w).otherwise(weight)
    return emd.groupBy("a", "b").agg((F.sum(F.col("emd") * weight) / F.sum(weight)).alias("distance"))
