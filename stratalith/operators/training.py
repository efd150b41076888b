"""Records of training and search: losses, convergence, scores, timers and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import d
from .joins import radius_join


def class_score(false_logit, true_logit, temperature: float = 1.0):
    """log10 of the softmax probability of true over that of false."""
    top = F.greatest(d(false_logit), d(true_logit))
    no, yes = (F.exp((d(x) - top) / temperature) for x in (false_logit, true_logit))
    return F.log10((yes / (no + yes)) / (no / (no + yes)))


def score_by_size(score, volume):
    """A score for each unit of molecular volume; null without one."""
    return F.try_divide(d(score), d(volume))


def overlap_loss(centres: DataFrame, group: str = "graph", point: str = "point") -> DataFrame:
    """(group, loss): sum over ordered pairs of molecule centres within twice the largest radius of max(0, 2 - distance / radius); 0 without one.

    centres: (group, point, x, y, z, radius), one radius a group. All pairs in reach count.
    """
    reach = 2 * (centres.agg(F.max("radius")).first()[0] or 0.0)
    e = radius_join(centres, centres, reach, group=group, point=point).filter("i <> j") if reach else None
    groups = centres.groupBy(group).agg(F.max("radius").alias("radius"))
    if e is None:
        return groups.select(group, F.lit(0.0).alias("loss"))
    near = e.join(groups, group).groupBy(group).agg(F.sum(F.greatest(F.lit(0.0), 2 - F.col("dist") / F.col("radius"))).alias("loss"))
    return groups.select(group).join(near, group, "left").select(group, F.coalesce("loss", F.lit(0.0)).alias("loss"))


def weighted_loss(terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``loss``: the weighted sum of columns; a missing term counts as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.col(name), F.lit(0.0))
    return terms.withColumn("loss", total)


def convergence(record: DataFrame, keys: list[str], order: str, history: int, eps: float, tolerance: float, test: str = "test", train: str | None = None, scrub: bool = True) -> DataFrame:
    """(keys, slope, ratio, converged) of each series.

    Converged: the record holds NaN or nothing; or the slope of log10(test) over the last ``history`` steps, without its highest twentieth where ``scrub``, is over
    -eps; or the mean of test / train over these steps is over ``tolerance``. A series needs ``history`` rows in memory, no more.
    """
    bad = record.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(test).isNull() | F.isnan(test)), F.lit(True)).alias("bad"))
    last = record.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_r") <= history)
    high = last.groupBy(*keys).agg(F.percentile(test, 0.95).alias("_q"), (F.avg(F.try_divide(F.col(test), F.col(train))) if train else F.lit(None).cast("double")).alias("ratio"))
    rows = last.join(high, keys).filter(F.col(test) < F.col("_q")) if scrub else last
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    slope = rows.withColumn("_i", place.cast("double")).groupBy(*keys).agg(F.regr_slope(F.log10(test), F.col("_i")).alias("slope"))
    out = bad.join(high.drop("_q"), keys, "left").join(slope, keys, "left")
    hit = F.col("bad") | F.coalesce(F.col("slope") > -eps, F.lit(False)) | F.coalesce(F.col("ratio") > tolerance, F.lit(False))
    return out.select(*keys, "slope", "ratio", hit.alias("converged"))


def phase_times(marks: DataFrame, keys: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """(keys, phase, time): ``x_end`` minus ``x_start`` of each phase that has both; of several marks the last counts."""
    phase = F.regexp_replace(name, "_(start|end)$", "")
    ends = marks.filter(F.col(name).rlike("_(start|end)$")).withColumn("phase", phase)
    of = lambda s: F.max(F.when(F.col(name).endswith(s), F.col(value)))
    return ends.groupBy(*keys, "phase").agg((of("_end") - of("_start")).alias("time")).filter("time IS NOT NULL")


def adaptive_histogram(df: DataFrame, value: str, bins: int, few: int = 10) -> DataFrame:
    """(low, high, n): a bin for each value where there are at most ``few``, else ``bins`` of one width from least to greatest. Empty bins have no row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if counts.limit(few + 1).count() <= few:
        return counts.select(F.col("v").alias("low"), F.col("v").alias("high"), "n")
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    width = (high - low) / bins
    at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
    return counts.groupBy(at.alias("b")).agg(F.sum("n").alias("n")).select((F.col("b") * width + low).alias("low"), ((F.col("b") + 1) * width + low).alias("high"), "n")


def canonical_order(atoms: DataFrame, key: str, kind: str, coords: tuple[str, str, str] = ("x", "y", "z"), tie: str = "atom") -> DataFrame:
    """Adds ``place``: atoms of a molecule by type, the farthest from the centroid first, ties by ``tie``."""
    centre = atoms.groupBy(key).agg(*(F.avg(a).alias(f"_{a}") for a in coords))
    rows = atoms.join(centre, key)
    d2 = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in coords), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy(key).orderBy(kind, F.desc(F.round(d2, 9)), tie)) - 1
    return rows.withColumn("place", place.cast("int")).drop(*(f"_{a}" for a in coords))


def within_cluster(molecules: DataFrame, radius: float, coords: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Molecules whose centroid lies within ``radius`` of the mean of all."""
    mean = molecules.agg(*(F.avg(a).alias(f"_{a}") for a in coords))
    d2 = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in coords), F.lit(0.0))
    return molecules.crossJoin(F.broadcast(mean)).filter(d2 < radius * radius).drop(*(f"_{a}" for a in coords))


def neighbours_by_distance(distances: DataFrame, cutoff: float) -> DataFrame:
    """(src, dst, dist) both ways of pairs (a, b, dist) under ``cutoff``: the graph of structures alike in their distribution functions."""
    near = distances.filter(F.col("dist") < cutoff)
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst"), "dist").unionByName(near.select(F.col("b").alias("src"), F.col("a").alias("dst"), "dist"))


def merged(main: dict, *bases: dict) -> dict:
    """Settings of ``main`` completed by those of each base in turn, nested ones one by one; what came first wins."""
    out = dict(main)
    for base in bases:
        for k, v in base.items():
            if k not in out:
                out[k] = v
            elif isinstance(out[k], dict) and isinstance(v, dict):
                out[k] = merged(out[k], v)
    return out


def as_dict(settings) -> object:
    """Nested objects with attributes as nested dictionaries."""
    if hasattr(settings, "__dict__"):
        settings = vars(settings)
    return {k: as_dict(v) for k, v in settings.items()} if isinstance(settings, dict) else settings
