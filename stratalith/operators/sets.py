"""Set operations over tables and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hashed_order


def replay_buffer(new: DataFrame, old: DataFrame, key: str, most: int) -> DataFrame:
    """New rows first, then old ones in a hashed order, up to ``most``."""
    both = new.withColumn("_old", F.lit(0)).unionByName(old.withColumn("_old", F.lit(1)))
    return both.orderBy("_old", F.when(F.col("_old") == 1, hashed_order(F.col(key))).otherwise(""), key).limit(most).drop("_old")


def complement(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad.select(key).distinct(), key, "left_anti")


def is_subset(inner, outer) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def merged_map(main, base) -> Column:
    """Entries of both maps; those of ``main`` win."""
    only = F.map_filter(base, lambda k, v: ~F.map_contains_key(main, k))
    return F.map_concat(main, only)
