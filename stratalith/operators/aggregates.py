"""Aggregations: segment reductions, clipped statistics, histograms, comparison metrics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import lens_volume, sphere_volume
from .windows import running_total

REDUCE = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def dense_reduce(groups: DataFrame, rows: DataFrame, key: str, value, how: str = "sum", name: str = "value") -> DataFrame:
    """A reduction for each group of ``groups``; 0 for a group without rows."""
    value = F.col(value) if isinstance(value, str) else value
    got = rows.groupBy(key).agg(REDUCE[how](value).alias(name))
    return groups.select(key).distinct().join(got, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def centroids(atoms: DataFrame, key: str, axes: tuple[str, ...] = ("x", "y", "z"), weight: Column | None = None) -> DataFrame:
    """Mean of each axis by group, weighted if asked."""
    if weight is None:
        return atoms.groupBy(key).agg(*(F.avg(a).alias(f"c_{a}") for a in axes))
    return atoms.groupBy(key).agg(*(F.try_divide(F.sum(F.col(a) * weight), F.sum(weight)).alias(f"c_{a}") for a in axes))


def centred(atoms: DataFrame, key: str, axes: tuple[str, ...] = ("x", "y", "z"), of: Column | None = None) -> DataFrame:
    """Atoms relative to the centroid of their group (of the atoms where ``of`` holds)."""
    c = atoms.filter(of) if of is not None else atoms
    return atoms.join(centroids(c, key, axes), key, "left").withColumns({a: F.col(a) - F.coalesce(f"c_{a}", F.lit(0.0)) for a in axes}).drop(*(f"c_{a}" for a in axes))


def radii(atoms: DataFrame, key: str, axes: tuple[str, ...] = ("x", "y", "z"), tie: str | None = None) -> DataFrame:
    """Largest distance to the centroid, and the farthest member (least ``tie`` among equals)."""
    r = sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0))
    rows = centred(atoms, key, axes).withColumn("_r", F.sqrt(r))
    aggs = [F.max("_r").alias("radius")]
    if tie:
        aggs.append(F.max_by(tie, F.struct("_r", -F.col(tie))).alias("farthest"))
    return rows.groupBy(key).agg(*aggs)


#: Up to so many values one aggregation buffer takes an exact quantile; of more, ranks are narrowed down by scans.
BUFFERED = 1_000_000


def kth_values(df: DataFrame, value: str, ranks: list[int], bins: int = 4096) -> dict[int, float]:
    """The values of given ranks (0: the least), exactly. Each scan counts the values of a range by bins (a small aggregation) and goes on with the bin that holds the rank."""
    v = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    low, high = v.agg(F.min("v"), F.max("v")).first()
    spans, found = {k: (low, high, 0) for k in ranks}, {}
    while spans:
        parts = []
        for k, (a, b, _) in spans.items():
            width = (b - a) / bins
            at = F.least(F.floor((F.col("v") - a) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
            parts.append(F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), at.cast("int").alias("b"))))
        met = v.select("v", F.explode(F.array_compact(F.array(*parts))).alias("s"))
        counts = met.groupBy("s.k", "s.b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k", "b").collect()
        for k, (_, _, before) in list(spans.items()):
            for r in counts:
                if r["k"] == k:
                    if before + r["n"] > k:
                        spans[k] = (r["low"], r["high"], before)
                        break
                    before += r["n"]
            if spans[k][0] == spans[k][1]:
                found[k] = spans.pop(k)[0]
    return found


def quantiles(df: DataFrame, value: str, names: dict[str, float], buffered: int = BUFFERED) -> DataFrame:
    """One row with exact quantiles, interpolated between ranks; nulls without values."""
    n = df.filter(F.col(value).isNotNull()).limit(buffered + 1).count()
    if n <= buffered:
        return df.agg(*(F.percentile(value, F.lit(p)).alias(k) for k, p in names.items()))
    n = df.agg(F.count(value)).first()[0]
    at = {k: p * (n - 1) for k, p in names.items()}
    got = kth_values(df, value, sorted({int(x) for x in at.values()} | {min(int(x) + 1, n - 1) for x in at.values()}))
    row = tuple(got[int(x)] + (x - int(x)) * (got[min(int(x) + 1, n - 1)] - got[int(x)]) for x in at.values())
    return df.sparkSession.createDataFrame([row], ", ".join(f"{k} double" for k in at))


def basic_stats(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: extremes, mean and sample std, and both again after clipping to two exact quantiles."""
    q = quantiles(df, value, {"q_low": low, "q_high": high})
    clipped = F.greatest(F.least(F.col(value).cast("double"), F.col("q_high")), F.col("q_low"))
    return df.crossJoin(F.broadcast(q)).agg(
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.avg(clipped).alias("tight_mean"), F.stddev_samp(clipped).alias("tight_std"), F.first("q_low").alias("q_low"), F.first("q_high").alias("q_high"),
    )


def standardized_target(df: DataFrame, value: str, name: str = "target") -> DataFrame:
    """Unclipped values by the mean and std of clipped ones; a std under 1e-4 counts as 1."""
    s = basic_stats(df, value).select("tight_mean", F.when(F.col("tight_std") < 1e-4, 1.0).otherwise(F.col("tight_std")).alias("tight_std"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, (F.col(value) - F.col("tight_mean")) / F.col("tight_std")).drop("tight_mean", "tight_std")


def stats_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics of each of several columns: one pass over the long form, and the quantiles of each."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select("s.*")
    plain = long.groupBy("name").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    parts = [quantiles(df, c, {"q05": 0.05, "q95": 0.95}).withColumn("name", F.lit(c)) for c in columns]
    return plain.join(F.broadcast(reduce(DataFrame.unionByName, parts)), "name")


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cov): the upper triangle, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.covar_samp(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("cov")) for i, (a, b) in enumerate(pairs)))).alias("s")).select("s.*")


def value_shares(df: DataFrame, value: str) -> DataFrame:
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def bin_of(value, low, width, bins: int) -> Column:
    """Bin from floor; the last bin is closed."""
    v = F.col(value) if isinstance(value, str) else value
    return F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")


def density_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n, density) over the range of the values; bins without rows are left out."""
    s = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(s)).select(F.when(width > 0, bin_of(value, F.col("_lo"), F.when(width > 0, width).otherwise(1.0), bins)).otherwise(0).alias("bin"), "_n", width.alias("_w"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count(F.lit(1)).cast("double"), F.first("_n") * F.first("_w")).alias("density"))


def rounded_histogram(df: DataFrame, key: str, value: str, high: float, bins: int) -> DataFrame:
    """By group, for values from 0 up: index = half-even rounding of the clipped value's share of ``high`` times bins."""
    w = high / bins
    at = F.rint(F.least(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(high - w)) / high * bins).cast("int")
    return df.groupBy(key, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def floor_histogram(df: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """By group; values out of range are dropped."""
    w = (high - low) / bins
    return df.filter((F.col(value) >= low) & (F.col(value) < high)).groupBy(key, F.floor((F.col(value) - low) / w).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def smooth_histogram(df: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Sum of Gaussians at bin centres linspace(low, high, bins), sigma = range / bins, times the bin width. Rows are met by fine value first."""
    sigma, step = (high - low) / bins, (high - low) / (bins - 1)
    some = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    grid = some.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    z = (F.col("_v") - (low + F.col("bin") * step)) / sigma
    return grid.groupBy(key, "bin").agg((F.sum(F.col("_n") * F.exp(-0.5 * z * z)) / (sigma * math.sqrt(2 * math.pi)) * sigma).alias("density"))


def histogram_overlap(hist: DataFrame, group: str, first, second) -> DataFrame:
    """sum of the lesser bins over the mean of both sums. hist: (group, bin, n)."""
    one = hist.groupBy("bin").agg(*(F.sum(F.when(F.col(group) == g, F.col("n")).otherwise(0)).cast("double").alias(a) for g, a in ((first, "a"), (second, "b"))))
    return one.agg(F.try_divide(F.sum(F.least("a", "b")), (F.sum("a") + F.sum("b")) / 2).alias("overlap"))


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    err = F.abs(F.col(truth) - F.col(guess))
    return df.agg(
        F.avg(err).alias("mae"), F.avg(F.try_divide(err, F.abs(F.col(truth)))).alias("relative_mae"), F.avg(err * err).alias("mse"),
        F.stddev_pop(err * err).alias("mse_std"), F.corr(truth, guess).alias("r"), F.regr_slope(guess, truth).alias("slope"),
    )


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n, share of the truth's rows)."""
    n = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from mean ranks of ties, over counts by score; 1 for a single class."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    r = running_total(by, score, "n", "upto").withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = r.agg(F.sum(F.col("rank") * F.col("p")).alias("rs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(F.when((F.col("p") == 0) | (F.col("p") == F.col("n")), 1.0).otherwise(F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def grouping_stats(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Statistics of a value for each of several groupings, in one scan."""
    cols = sorted({c for s in sets for c in s})
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def molecule_volume(atoms: DataFrame, key: str, pairs: DataFrame, shrink: float = 0.7272) -> DataFrame:
    """Spheres minus ``shrink`` times the overlaps of pairs. atoms: (key, r); pairs: (key, ri, rj, dist)."""
    whole = atoms.groupBy(key).agg(F.sum(sphere_volume("r")).alias("spheres"))
    overlap = pairs.groupBy(key).agg(F.sum(lens_volume("ri", "rj", "dist")).alias("overlap"))
    return whole.join(overlap, key, "left").select(key, (F.col("spheres") - shrink * F.coalesce("overlap", F.lit(0.0))).alias("volume"))


def inertia(atoms: DataFrame, key: str) -> DataFrame:
    """Six sums of the unit-mass inertia tensor about the centroid; atoms: (key, x, y, z)."""
    c = centred(atoms, key)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return c.groupBy(key).agg(F.sum(y * y + z * z).alias("ixx"), F.sum(x * x + z * z).alias("iyy"), F.sum(x * x + y * y).alias("izz"), F.sum(-x * y).alias("ixy"), F.sum(-x * z).alias("ixz"), F.sum(-y * z).alias("iyz"))


def principal_axes(atoms: DataFrame, key: str) -> DataFrame:
    """(key, moments, axes): eigenvalues in order and eigenvectors as rows, each turned to the farthest atom.

    Sums are taken by Spark; only the 3 x 3 problem of each group goes to numpy, in batches.
    """
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    far = centred(atoms, key).groupBy(key).agg(F.max(F.struct(r2.alias("r2"), "x", "y", "z")).alias("far"))
    rows = inertia(atoms, key).join(far, key)

    def step(frames):
        for p in frames:
            m = np.empty((len(p), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    m[:, i, j] = p["i" + "".join(sorted((a, b)))]
            values, vectors = np.linalg.eigh(m)
            axes = vectors.transpose(0, 2, 1)
            far = p[["fx", "fy", "fz"]].to_numpy()
            sign = np.where(np.einsum("nij,nj->ni", axes, far) < 0, -1.0, 1.0)
            yield pd.DataFrame({key: p[key], "moments": list(values), "axes": [a.tolist() for a in axes * sign[:, :, None]]})

    flat = rows.select(key, "ixx", "iyy", "izz", "ixy", "ixz", "iyz", F.col("far.x").alias("fx"), F.col("far.y").alias("fy"), F.col("far.z").alias("fz"))
    return flat.mapInPandas(step, f"{key} {dict(atoms.dtypes)[key]}, moments array<double>, axes array<array<double>>")


def dipole(atoms: DataFrame, key: str, charge: str) -> DataFrame:
    """Charge-weighted mean position minus the mean position."""
    return atoms.groupBy(key).agg(*((F.avg(F.col(charge) * F.col(a)) - F.avg(a)).alias(f"d_{a}") for a in "xyz"))
