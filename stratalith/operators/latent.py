"""Crystal parameters as latent variables: invertible maps, composed by name."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import d, enforce_bound, normal_to_uniform, uniform_to_normal

# Means and stds of asymmetric-unit lengths over the molecule's radius; all axes use their average.
LENGTH_MEANS, LENGTH_STDS = (1.0563, 0.7978, 1.7570), (0.6001, 0.5115, 0.7147)


def aunit_lengths(cell: tuple[str, str, str], box: tuple[str, str, str]) -> tuple[Column, ...]:
    """Cell lengths in the asymmetric unit's basis."""
    return tuple(d(x) * d(b) for x, b in zip(cell, box, strict=True))


def standard_lengths(cell, box, radius) -> tuple[Column, ...]:
    mean, std = sum(LENGTH_MEANS) / 3, sum(LENGTH_STDS) / 3
    return tuple((x / d(radius) - mean) / std for x in aunit_lengths(cell, box))


def destandard_lengths(standard, box, radius) -> tuple[Column, ...]:
    mean, std = sum(LENGTH_MEANS) / 3, sum(LENGTH_STDS) / 3
    return tuple((d(x) * std + mean) * d(radius) / d(b) for x, b in zip(standard, box, strict=True))


@dataclass(frozen=True)
class Bounded:
    """[low, high] to [-1, 1], linearly."""

    low: float
    high: float

    def forward(self, x) -> Column:
        return (d(x) - self.low) / (self.high - self.low) * 2 - 1

    def inverse(self, y) -> Column:
        return (d(y) + 1) / 2 * (self.high - self.low) + self.low


@dataclass(frozen=True)
class Squashed:
    """All numbers to (-1, 1), steep near the centre."""

    centre: float
    width: float

    def forward(self, x) -> Column:
        return F.tanh((d(x) - self.centre) / self.width)

    def inverse(self, y) -> Column:
        y = F.greatest(F.lit(-1 + 1e-9), F.least(F.lit(1 - 1e-9), d(y)))
        return 0.5 * F.log((1 + y) / (1 - y)) * self.width + self.centre


@dataclass(frozen=True)
class LogNormal:
    """Positive numbers to standard normal ones."""

    mean: float
    std: float

    def forward(self, x) -> Column:
        return (F.log(d(x)) - self.mean) / self.std

    def inverse(self, y) -> Column:
        return F.exp(d(y) * self.std + self.mean)


@dataclass(frozen=True)
class Probit:
    """(0, 1) to normal values."""

    def forward(self, x) -> Column:
        return uniform_to_normal(x)

    def inverse(self, y) -> Column:
        return normal_to_uniform(y)


@dataclass(frozen=True)
class Angle:
    """A polar angle to a variable in which directions are uniform: cos for theta, a share of the turn for phi."""

    polar: bool

    def forward(self, x) -> Column:
        return F.cos(d(x)) if self.polar else d(x) / math.pi

    def inverse(self, y) -> Column:
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d(y)))) if self.polar else d(y) * math.pi


@dataclass(frozen=True)
class Identity:
    def forward(self, x) -> Column:
        return d(x)

    def inverse(self, y) -> Column:
        return d(y)


class Composite:
    """Maps applied one after another; the inverse goes back in reverse."""

    def __init__(self, *maps):
        self.maps = maps

    def forward(self, x) -> Column:
        for t in self.maps:
            x = t.forward(x)
        return x

    def inverse(self, y) -> Column:
        for t in reversed(self.maps):
            y = t.inverse(y)
        return y


def encode(df: DataFrame, maps: dict[str, object]) -> DataFrame:
    """Columns through their maps."""
    return df.withColumns({c: t.forward(F.col(c)) for c, t in maps.items()})


def decode(df: DataFrame, maps: dict[str, object]) -> DataFrame:
    return df.withColumns({c: t.inverse(F.col(c)) for c, t in maps.items()})


def clean_cell(df: DataFrame, system: str, least: float = 3.0, spread: float = 0.6, hard: bool = True) -> DataFrame:
    """Lengths of at least ``least``, angles within ``spread`` half pi of a right one, centroids in [0, 1], then the system's rules."""
    right = math.pi / 2
    mode = "hard" if hard else "soft"
    out = df.withColumns({a: F.greatest(d(a), F.lit(least)) for a in "abc"} | {a: enforce_bound(a, right, spread * right, mode) for a in ("alpha", "beta", "gamma")})
    if "fx" in df.columns:
        out = out.withColumns({f"f{a}": enforce_bound(f"f{a}", 0.5, 0.5, mode) for a in "xyz"})
    return out.withColumns(g.enforce_system(system, "a", "b", "c", "alpha", "beta", "gamma"))
