"""Conformers in internal coordinates: tree building, measuring, force-field terms, typed priors."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def tree_of(n: int, bonds: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(atom, parent, grandparent, great-grandparent) breadth first from the graph's centre; -1 where there is none.

    Reference atoms at the root are completed by earlier placed atoms, so that only the first three lack some.
    """
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in bonds:
        near[a].add(b)
        near[b].add(a)

    def far(s):
        seen, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in sorted(near[u]):
                if v not in seen:
                    seen[v] = seen[u] + 1
                    todo.append(v)
        return seen

    reach = [far(s) for s in range(n)]
    if n and len(reach[0]) < n:
        raise ValueError("the bond graph is not connected")
    root = min(range(n), key=lambda s: (max(reach[s].values()), s)) if n else 0
    parent, order, todo = {root: -1}, [], deque([root] if n else [])
    while todo:
        u = todo.popleft()
        order.append(u)
        for v in sorted(near[u]):
            if v not in parent:
                parent[v] = u
                todo.append(v)
    out, placed = [], []
    for u in order:
        refs: list[int] = []
        v = parent[u]
        while v != -1 and len(refs) < 3:
            refs.append(v)
            v = parent[v]
        refs += [w for w in placed if w not in refs][: 3 - len(refs)] if placed else []
        out.append((u, *(refs + [-1] * 3)[:3]))
        placed.append(u)
    return out


def spanning_trees(bonds: DataFrame, sizes: DataFrame, key: str = "mol") -> DataFrame:
    """(key, rank, atom, p1, p2, p3) for each molecule. bonds: (key, src, dst); sizes: (key, n)."""

    def solve(_, s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if s.empty:
            return pd.DataFrame({key: [], "rank": [], "atom": [], "p1": [], "p2": [], "p3": []})
        rows = tree_of(int(s["n"].iloc[0]), list(zip(b["src"], b["dst"], strict=True)))
        return pd.DataFrame([(s[key].iloc[0], i, *r) for i, r in enumerate(rows)], columns=[key, "rank", "atom", "p1", "p2", "p3"])

    return sizes.select(key, "n").groupBy(key).cogroup(bonds.select(key, "src", "dst").groupBy(key)).applyInPandas(solve, f"{key} {dict(sizes.dtypes)[key]}, rank int, atom int, p1 int, p2 int, p3 int")


def measure(atoms: DataFrame, tree: DataFrame, key: str = "mol", atom: str = "atom") -> DataFrame:
    """(key, rank, atom, length, angle, torsion) of each tree row; null where references are missing."""
    rows = tree
    for name, column in (("u", "atom"), ("p", "p1"), ("q", "p2"), ("r", "p3")):
        side = atoms.select(key, F.col(atom).alias(column), *(F.col(a).alias(f"{name}{a}") for a in "xyz"))
        rows = rows.join(side, [key, column], "left")
    u, p, q, r = (g.vec(*(f"{n}{a}" for a in "xyz")) for n in "upqr")
    return rows.select(key, "rank", "atom", g.bond_length(u, p).alias("length"), g.bond_angle(u, p, q).alias("angle"), g.dihedral(r, q, p, u).alias("torsion"))


def closure_error(atoms: DataFrame, bonds: DataFrame, key: str = "mol", atom: str = "atom") -> DataFrame:
    """Largest |length - r0| of bonds by molecule. bonds: (key, src, dst, r0)."""
    e = bonds
    for s in ("src", "dst"):
        e = e.join(atoms.select(key, F.col(atom).alias(s), *(F.col(a).alias(f"{s}_{a}") for a in "xyz")), [key, s])
    length = g.bond_length(g.vec(*(f"src_{a}" for a in "xyz")), g.vec(*(f"dst_{a}" for a in "xyz")))
    return e.groupBy(key).agg(F.max(F.abs(length - F.col("r0"))).alias("closure_error"))


def harmonic_term(x, k, x0) -> Column:
    return 0.5 * F.col(k) * (F.col(x) - F.col(x0)) * (F.col(x) - F.col(x0))


def torsion_term(phi, k, periodicity, phase) -> Column:
    return F.col(k) * (1 + F.cos(F.col(periodicity) * F.col(phi) - F.col(phase)))


def soft_core(d, s, eps, alpha: float = 0.5) -> Column:
    """Lennard-Jones with a finite core."""
    r6 = F.pow(F.col(d), 6) / F.pow(F.col(s), 6)
    x = 1 / (alpha + r6)
    return 4 * F.col(eps) * (x * x - x)


def buffered_14_7(d, s, eps) -> Column:
    x = F.col(d) / F.col(s)
    x7 = F.pow(x, 7)
    return F.col(eps) * F.pow(1.07 / (x + 0.07), 7) * (1.12 / (x7 + 0.12) - 2)


def total_energy(terms: list[DataFrame], key: str = "mol") -> DataFrame:
    """Sum by molecule and kind over term tables (key, kind, energy)."""
    out = terms[0]
    for t in terms[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).pivot("kind", ["bond", "angle", "torsion", "improper", "pair"]).agg(F.sum("energy")).na.fill(0.0)


def fit_prior(values: DataFrame, bins: int, low: float, high: float, uniform: float = 0.15) -> DataFrame:
    """(key, bin, log_p): typed histogram density mixed with the uniform one. values: (key, v); every bin of every key."""
    w = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col("v") - low) / w), F.lit(0)), F.lit(bins - 1)).cast("int")
    n = values.groupBy("key", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("key").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(n, ["key", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("key"))
    return full.select("key", "bin", F.log(((1 - uniform) * share + uniform / bins) / w).alias("log_p"))


def log_prob(values: DataFrame, prior: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """Log density of each value; an unknown key has the uniform one."""
    w = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col("v") - low) / w), F.lit(0)), F.lit(bins - 1)).cast("int")
    return values.withColumn("bin", at).join(prior, ["key", "bin"], "left").withColumn("log_p", F.coalesce("log_p", F.lit(-math.log(high - low)))).drop("bin")


def sample_prior(keys: DataFrame, prior: DataFrame, bins: int, low: float, high: float, u: str = "u") -> DataFrame:
    """A value for each (key, u) by the inverse distribution function, linear within a bin."""
    w = (high - low) / bins
    by = Window.partitionBy("key").orderBy("bin")
    c = prior.withColumn("p", F.exp("log_p") * w).withColumn("hi", F.sum("p").over(by)).withColumn("lo", F.col("hi") - F.col("p"))
    met = keys.join(c, "key").filter((F.col(u) >= F.col("lo")) & ((F.col(u) < F.col("hi")) | (F.col("bin") == bins - 1)))
    return met.select(*keys.columns, (low + w * (F.col("bin") + (F.col(u) - F.col("lo")) / F.col("p"))).alias("v"))
