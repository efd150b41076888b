"""Hooks for models and chemistry toolkits that aren't part of this package.

A plug-in is loaded once per worker and called on batches. Weights and toolkits are the user's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Plugins:
    """Named loaders: name -> function that returns a callable from a pandas frame to a pandas frame."""

    def __init__(self):
        self.loaders: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {}

    def add(self, name: str, loader: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
        self.loaders[name.lower()] = loader

    def apply(self, df: DataFrame, name: str, schema, batch_rows: int | None = None) -> DataFrame:
        """Rows in, rows out; one row may give none or many. A batch that fails for lack of memory is halved and tried again."""
        loader = self.loaders[name.lower()]

        def step(frames):
            model = loader()
            for p in frames:
                todo = [p[i : i + batch_rows] for i in range(0, len(p), batch_rows)] if batch_rows else [p]
                while todo:
                    part = todo.pop(0)
                    try:
                        yield model(part)
                    except MemoryError:
                        if len(part) < 2:
                            raise
                        todo[:0] = [part[: len(part) // 2], part[len(part) // 2 :]]

        return df.mapInPandas(step, schema)


def dropout_mean(draws: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and sample std over draws."""
    return draws.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def gaussian_basis(dist: str, high: float, n: int):
    """Radial basis of n Gaussians over [0, high]."""
    w = high / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(-F.pow((F.col(dist) - i * w) / w, 2)))


def message_sum(edges: DataFrame, features: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """One round of message passing: the sum of neighbours' features over edges (src, dst)."""
    return edges.join(features.withColumnRenamed(node, "src"), "src").groupBy(F.col("dst").alias(node)).agg(*(F.sum(c).alias(c) for c in columns))
