"""Iterative operators: per-row optimisation, schedules, search in stages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hashed_order


def optimise_rows(df: DataFrame, key: str, params: list[str], loss: Callable[[np.ndarray], np.ndarray], steps: int = 200, rate: float = 0.05, tolerance: float = 1e-6) -> DataFrame:
    """Gradient descent on each row's parameters, rows of a batch at once. loss: (n, p) array -> n losses.

    Central differences and a step halved where the loss rose; rows stop moving when a step gains under ``tolerance``.
    """

    def step(frames):
        for p in frames:
            x = p[params].to_numpy(float)
            now, r, live = loss(x), np.full(len(x), rate), np.ones(len(x), bool)
            n = np.zeros(len(x), int)
            for _ in range(steps):
                if not live.any():
                    break
                grad = np.zeros_like(x)
                for j in range(x.shape[1]):
                    h = np.zeros(x.shape[1])
                    h[j] = 1e-5
                    grad[:, j] = (loss(x + h) - loss(x - h)) / 2e-5
                new = np.where(live[:, None], x - r[:, None] * grad, x)
                got = loss(new)
                better = live & (got < now)
                live &= (r > 1e-12) & ~(better & (now - got < tolerance))
                x, now, r = np.where(better[:, None], new, x), np.where(better, got, now), np.where(better, r * 1.1, r * 0.5)
                n += better
            yield pd.DataFrame({key: p[key]} | {c: x[:, j] for j, c in enumerate(params)} | {"loss": now, "steps": n})

    kinds = ", ".join([f"{key} {dict(df.dtypes)[key]}", *(f"{c} double" for c in params), "loss double", "steps long"])
    return df.select(key, *params).mapInPandas(step, kinds)


def annealed(start: float, factor: float, step: int, least: float) -> float:
    return max(least, start * factor**step)


def search_space(first: DataFrame, second: DataFrame, most: int, *keys: str) -> DataFrame:
    """A bounded number of combinations in a hashed order. One side must be a small dimension table."""
    return first.crossJoin(F.broadcast(second)).orderBy(hashed_order(*(F.col(k) for k in keys)), *keys).limit(most)


def draws(df: DataFrame, n: int) -> DataFrame:
    """n numbered draws of each row, for Monte Carlo estimates."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
