"""Pair energies: an expression for each edge, all asked for reduced in one aggregation.

Edges have ``dist``, the sum of radii ``s`` and, for electrostatics, ``q1`` and ``q2``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, relu, silu

D, S = F.col, F.col


def _ratio6(d: Column, s: Column) -> Column:
    x = s / d
    return F.pow(x, 6)


def lennard_jones(d: Column, s: Column) -> Column:
    r6 = _ratio6(d, s)
    return 4 * (r6 * r6 - r6)


def quadratic_core(d: Column, s: Column) -> Column:
    return F.when(d < s, 24 * ((d - s) * (d - s) / (s * s) - (d - s) / s)).otherwise(lennard_jones(d, s))


def exponential_core(d: Column, s: Column, repulsion: float = 1.0) -> Column:
    stiff = 2.5 * repulsion
    return F.when(d < s, 24 / stiff * (F.exp(-stiff / s * (d - s)) - 1)).otherwise(lennard_jones(d, s))


def screened_coulomb(d: Column, q1: Column, q2: Column) -> Column:
    return q1 * q2 / d * F.exp(-0.92 * d)


def buckingham(d: Column, s: Column, a: float = -3.2619, b: float = 1.0, c: float = -0.2) -> Column:
    x = d / s
    return a * F.exp(-b * x) - c / F.pow(x, 6)


def silu_contact(d: Column, s: Column, repulsion: float = 1.0) -> Column:
    return silu(-4 * (d - s * repulsion) * repulsion) / 0.28


def overlap(d: Column, s: Column) -> Column:
    return relu(s - d)


class Registry:
    """Energies by name, in any case; open for more."""

    def __init__(self):
        self.edge: dict[str, tuple[Callable[[], Column], Callable[[Column], Column]]] = {}

    def add(self, name: str, edge: Callable[[], Column], reduce: Callable[[Column], Column] = F.sum) -> None:
        self.edge[name.lower()] = (edge, reduce)

    def columns(self, names: list[str]) -> list[Column]:
        missing = [n for n in names if n.lower() not in self.edge]
        if missing:
            raise KeyError(f"no energy named {missing}; known: {sorted(self.edge)}")
        return [self.edge[n.lower()][1](finite(self.edge[n.lower()][0]())).alias(n.lower()) for n in names]


def default_registry() -> Registry:
    r, d, s = Registry(), F.col("dist"), F.col("s")
    # An edge of length 0 gives what the limit gives after sanitising.
    safe = F.greatest(d, F.lit(1e-3))
    r.add("lj", lambda: lennard_jones(safe, s))
    r.add("qlj", lambda: quadratic_core(safe, s))
    r.add("elj", lambda: exponential_core(safe, s))
    r.add("coulomb", lambda: screened_coulomb(safe, F.col("q1"), F.col("q2")))
    r.add("buckingham", lambda: buckingham(safe, s))
    r.add("silu", lambda: silu_contact(d, s))
    r.add("vdw", lambda: overlap(d, s))
    r.add("max_overlap", lambda: overlap(d, s), F.max)
    return r


def energies(edges: DataFrame, groups: DataFrame, key: str, names: list[str], registry: Registry | None = None) -> DataFrame:
    """All energies asked for, for each group; 0 where a group has no edges."""
    got = edges.groupBy(key).agg(*(registry or default_registry()).columns(names))
    out = groups.select(key).distinct().join(got, key, "left")
    return out.select(key, *(F.coalesce(n.lower(), F.lit(0.0)).alias(n.lower()) for n in names))


def harmonic(x: list[str], centre: list[float], width: list[float]) -> Column:
    """Half the squared distance in widths."""
    return 0.5 * sum((((F.col(a) - c) / w) * ((F.col(a) - c) / w) for a, c, w in zip(x, centre, width, strict=True)), F.lit(0.0))


def mixture_energy(x: list[str], weights: list[float], centres: list[list[float]], widths: list[list[float]]) -> Column:
    """-log of a mixture of axis-aligned normals, by log-sum-exp."""
    import math

    logs = []
    for w, c, s in zip(weights, centres, widths, strict=True):
        const = math.log(w) - sum(math.log(v * math.sqrt(2 * math.pi)) for v in s)
        logs.append(F.lit(const) - harmonic(x, c, s))
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return -(top + F.log(sum((F.exp(v - top) for v in logs), F.lit(0.0))))


def metropolis(old, new, temperature: float, u) -> Column:
    """Whether a move is accepted."""
    return F.col(u) < F.least(F.lit(1.0), F.exp(F.least(F.lit(0.0), -(F.col(new) - F.col(old)) / temperature)))


def hydrogen_bonds(edges: DataFrame, groups: DataFrame, key: str, cutoff: float = 3.3) -> DataFrame:
    """Donor-acceptor contacts by group; edges have ``donor`` and ``acceptor`` flags of their ends."""
    n = edges.filter((F.col("dist") < cutoff) & F.col("donor") & F.col("acceptor")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
