"""Ordered operators: repeats, running means, decayed means, convergence, top-k, samples, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def last_of_runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose next row in order has another value; the last of each run stays."""
    nxt = F.lead(F.struct(value)).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", nxt).filter(F.col("_n").isNull() | ~F.col(f"_n.{value}").eqNullSafe(F.col(value))).drop("_n")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    return df.withColumn(name, F.last(value, True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def running_mean(keys: list[str], order: list[str], value: str) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def relative_change(keys: list[str], order: list[str], value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    before = F.lag(v).over(Window.partitionBy(*keys).orderBy(*order))
    return F.try_divide(F.abs(v - before), F.abs(before))


def decayed_mean(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Normalised exponentially decayed mean up to each row: weights (1 - alpha) ** age.

    Two running sums with weights scaled by the row number; blocks of 64 rows carry their sums on, so that long series don't overflow.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    r, block = F.row_number().over(w) - 1, 64
    rows = df.withColumn("_b", F.floor(r / block).cast("long")).withColumn("_i", F.pmod(r, F.lit(block)))
    up = F.pow(F.lit(1 - alpha), -F.col("_i").cast("double"))
    own = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum(F.col(value) * up).over(own) * F.pow(F.lit(1 - alpha), F.col("_i").cast("double"))).withColumn("_w", F.sum(up).over(own) * F.pow(F.lit(1 - alpha), F.col("_i").cast("double")))
    ends = rows.groupBy(*keys, "_b").agg(F.max_by("_s", "_i").alias("es"), F.max_by("_w", "_i").alias("ew"))
    # Past blocks decay below 1e-16 after a bounded number of them.
    reach = max(1, int(-37 / (block * math.log(1 - alpha))) + 1)
    older = Window.partitionBy(*keys).orderBy("_b").rowsBetween(-reach, -1)
    past = F.collect_list(F.struct("_b", "es", "ew")).over(older)

    def carried(c):
        return F.aggregate(past, F.lit(0.0), lambda s, x: s + x[c] * F.pow(F.lit(1 - alpha), ((F.col("_b") - x["_b"] - 1) * block).cast("double")))

    carry = ends.select(*keys, "_b", carried("es").alias("ps"), carried("ew").alias("pw"))
    far = F.pow(F.lit(1 - alpha), (F.col("_i") + 1).cast("double"))
    out = rows.join(carry, [*keys, "_b"])
    return out.withColumn(name, (F.col("_s") + F.col("ps") * far) / (F.col("_w") + F.col("pw") * far)).drop("_b", "_i", "_s", "_w", "ps", "pw")


def gaussian_smooth(keys: list[str], order: list[str], value: str, sigma: float) -> Column:
    """Weighted mean of the rows within 4 sigma, weights renormalised at the ends."""
    k = int(4 * sigma + 0.5)
    w = Window.partitionBy(*keys).orderBy(*order)
    top, low = F.lit(0.0), F.lit(0.0)
    for i in range(-k, k + 1):
        weight = math.exp(-0.5 * (i / sigma) ** 2)
        v = F.lead(value, i).over(w) if i > 0 else F.lag(value, -i).over(w) if i < 0 else F.col(value)
        top, low = top + F.coalesce(v * weight, F.lit(0.0)), low + F.when(v.isNotNull(), weight).otherwise(0.0)
    return top / low


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def even_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at positions floor(i (n - 1) / (k - 1)) of the order."""
    ranked = with_position(df, order)
    n = df.count()
    k = min(k, n)
    if k == 0:
        return ranked.limit(0).drop("_pos")
    spark = df.sparkSession
    at = spark.range(k).select(F.floor(F.col("id") * F.lit(n - 1) / F.lit(max(1, k - 1))).cast("long").alias("_pos")).distinct()
    return ranked.join(F.broadcast(at), "_pos").drop("_pos")


def with_position(df: DataFrame, order: str, name: str = "_pos") -> DataFrame:
    """Position in order from 0, without one window over all rows: ranges, their counts, then a rank within each."""
    spread = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    n = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return spread.join(F.broadcast(before), "_p").withColumn(name, (F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1).cast("long")).drop("_p", "_b")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of a value over all rows up to each, in order, by ranges like ``with_position``. order: no two rows alike."""
    spread = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sums = spread.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return spread.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + own).drop("_p", "_b")


def split_first(df: DataFrame, order: str, train_fraction: float) -> DataFrame:
    """Column ``split``: the first n - int(f n) rows are test, the rest train."""
    n = df.count()
    cut = n - int(train_fraction * n)
    return with_position(df, order).withColumn("split", F.when(F.col("_pos") < cut, "test").otherwise("train")).drop("_pos")


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    return with_position(df, order).filter(F.col("_pos") % n == 0).drop("_pos")


def trend(df: DataFrame, keys: list[str], order: list[str], value: str, last: int) -> DataFrame:
    """Slope of log10(value) over the last rows of each key, without those over their 95 % quantile."""
    recent = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).filter((F.col("_r") <= last) & (F.col(value) > 0))
    q = recent.groupBy(*keys).agg(F.percentile(value, F.lit(0.95)).alias("_q"))
    return recent.join(q, keys).filter(F.col(value) <= F.col("_q")).groupBy(*keys).agg(F.regr_slope(F.log10(value), -F.col("_r").cast("double")).alias("slope"))
