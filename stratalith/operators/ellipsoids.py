"""Molecules as ellipsoids, and seeded volume integrals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ellipsoid_volume
from ..functions.scalars import hashed_uniform
from .aggregates import centred


def ellipsoids(atoms: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, p, q, r, volume): semi-axes sqrt(5 eigenvalue) of the covariance of positions, of at least ``least``."""
    c = centred(atoms, key)
    sums = c.groupBy(key).agg(*(F.avg(F.col(a) * F.col(b)).alias(a + b) for i, a in enumerate("xyz") for b in "xyz"[i:]))

    def step(frames):
        for f in frames:
            m = np.empty((len(f), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    m[:, i, j] = f["".join(sorted(a + b))]
            axes = np.maximum(np.sqrt(5 * np.maximum(np.linalg.eigvalsh(m), 0)), least)
            yield pd.DataFrame({key: f[key], "p": axes[:, 0], "q": axes[:, 1], "r": axes[:, 2]})

    out = sums.mapInPandas(step, f"{key} {dict(atoms.dtypes)[key]}, p double, q double, r double")
    return out.withColumn("volume", ellipsoid_volume("p", "q", "r"))


def ellipsoid_overlap(pairs: DataFrame, probes: int, seed: int = 1, key: str = "pair") -> DataFrame:
    """(key, overlap): share of seeded probes in the first ellipsoid that the second, at (dx, dy, dz), also holds, times the first's volume. Axis-aligned; 0 at once where bounding spheres can't meet."""
    far = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")) > F.greatest("p1", "q1", "r1") + F.greatest("p2", "q2", "r2")
    near = pairs.filter(~far).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(probes))))
    u = [hashed_uniform(F.lit(seed), F.lit(i), F.col(key), F.col("n")) for i in range(3)]
    r, cos, phi = F.pow(u[0], 1 / 3), 2 * u[1] - 1, 2 * math.pi * u[2]
    sin = F.sqrt(1 - cos * cos)
    at = (F.col("p1") * r * sin * F.cos(phi) - F.col("dx"), F.col("q1") * r * sin * F.sin(phi) - F.col("dy"), F.col("r1") * r * cos - F.col("dz"))
    inside = sum(((x / F.col(a)) * (x / F.col(a)) for x, a in zip(at, ("p2", "q2", "r2"), strict=True)), F.lit(0.0)) <= 1
    got = near.groupBy(key).agg((F.avg(inside.cast("double")) * F.first(ellipsoid_volume("p1", "q1", "r1"))).alias("overlap"))
    return pairs.select(key).join(got, key, "left").select(key, F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def grid_volume(atoms: DataFrame, key: str, step: float, slab: int = 64) -> DataFrame:
    """(key, volume): cells of a grid whose centre some sphere covers. atoms: (key, x, y, z, r).

    A sphere covers one run of cells in each column along z; runs of a column are united, no cell is a row. A key is dealt
    by slabs of ``slab`` cells along x, so that large ones are shared by tasks.
    """
    lo, hi = (F.floor(F.floor((F.col("x") + side * F.col("r")) / step) / slab) for side in (-1, 1))
    own = F.struct(*(F.col(a).cast("double").alias(a) for a in "xyzr"))
    found = atoms.filter(" AND ".join(f"{a} IS NOT NULL" for a in (key, "x", "y", "z", "r")))
    dealt = found.withColumn("_s", F.explode(F.sequence(lo, hi))).groupBy(key, "_s").agg(F.collect_list(own).alias("_a"))

    def count(batches):
        for b in batches:
            many = np.diff(b.column(2).offsets.to_numpy())
            of, flat = np.repeat(np.arange(len(many)), many), b.column(2).flatten()
            at, first = np.array([np.asarray(flat.field(k)) for k in range(4)]).reshape(4, -1), b.column(1).to_numpy() * slab
            total = np.zeros(len(many), np.int64)
            wide = np.floor((at[0] + at[3]) / step) - np.floor((at[0] - at[3]) / step) + 1, np.floor((at[1] + at[3]) / step) - np.floor((at[1] - at[3]) / step) + 1
            ends = np.cumsum(np.bincount(of, np.minimum(wide[0], slab) * wide[1], len(many)))
            cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(1_000_000, ends[-1] if len(ends) else 0, 1_000_000)), [len(many)]]))
            start = 0
            for end in cuts:  # whole rows, of about a million columns together
                s = slice(*np.searchsorted(of, [start, end]))
                total[start:end] = covered(at[:, s], of[s] - start, first[start:end], slab, step, end - start)
                start = end
            yield pa.record_batch([b.column(0), pa.array(total)], names=[key, "_n"])

    cells = dealt.select(key, "_s", "_a").mapInArrow(count, f"`{key}` {dict(atoms.dtypes)[key]}, _n long")
    return cells.groupBy(key).agg(F.sum("_n").alias("_n")).filter("_n > 0").select(key, (F.col("_n") * step**3).alias("volume"))


def covered(at: np.ndarray, of: np.ndarray, first: np.ndarray, slab: int, step: float, n: int) -> np.ndarray:
    """Cells that the spheres (x, y, z, r) of each of n rows cover from ``first`` on along x, ``slab`` cells wide. of: the row of each sphere, in order."""

    def listed(low, high):
        many = np.maximum(high - low + 1, 0)
        which = np.repeat(np.arange(len(many)), many)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which]

    x, y, z, r = at
    low, high = (np.floor((v - r) / step).astype(np.int64) for v in (x, y)), (np.floor((v + r) / step).astype(np.int64) for v in (x, y))
    (lx, ly), (hx, hy) = low, high
    a, cx = listed(np.maximum(lx, first[of]), np.minimum(hx, first[of] + slab - 1))
    b, cy = listed(ly[a], hy[a])
    a, cx = a[b], cx[b]
    d2 = ((cx + 0.5) * step - x[a]) ** 2
    d2 = d2 + ((cy + 0.5) * step - y[a]) ** 2
    rr = r * r
    in_reach = d2 <= rr[a]
    a, cx, cy, d2 = a[in_reach], cx[in_reach], cy[in_reach], d2[in_reach]
    half = np.sqrt(rr[a] - d2)
    inside = lambda c: d2 + ((c + 0.5) * step - z[a]) ** 2 <= rr[a]
    # The estimates may be one off; what counts is whether a cell's centre is inside.
    lo, hi = np.ceil((z[a] - half) / step - 0.5).astype(np.int64), np.floor((z[a] + half) / step - 0.5).astype(np.int64)
    lo = np.where(inside(lo - 1), lo - 1, np.where(inside(lo), lo, lo + 1))
    hi = np.where(inside(hi + 1), hi + 1, np.where(inside(hi), hi, hi - 1))
    some = hi >= lo
    a, cx, cy, lo, hi = a[some], cx[some], cy[some], lo[some], hi[some]
    row = of[a]
    if len(of) == len(np.unique(of)):  # one sphere a row: nothing to unite
        return np.bincount(row, hi - lo + 1, n).astype(np.int64)
    order = np.lexsort((lo, cy, cx, row))
    row, cx, cy, lo, hi = row[order], cx[order], cy[order], lo[order], hi[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])
    if not len(row):
        return np.zeros(n, np.int64)
    apart = np.cumsum(new) * (hi.max() - lo.min() + 2)  # columns one after another, so that one running maximum serves all
    top = np.maximum.accumulate(hi + apart)
    before = np.concatenate([[lo[0] + apart[0] - 1], top[:-1]])
    before = np.where(new, lo + apart - 1, before)
    return np.bincount(row, np.maximum(hi + apart - np.maximum(lo + apart - 1, before), 0), n).astype(np.int64)
