"""Crystals: asymmetric unit, unit cell, cluster, and back."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import hashed_uniform, uniform_to_normal
from ..functions.tables import crystal_system
from .aggregates import centroids, principal_axes, radii
from .joins import radius_join, symmetry_images

CELL = ("a", "b", "c", "alpha", "beta", "gamma")


def with_cell(crystals: DataFrame) -> DataFrame:
    """Adds the 3 x 3 matrices (f2c_ij, c2f_ij), volume, and packing and density where mass and volume are known."""
    f2c, c2f = g.frac_to_cart(*CELL), g.cart_to_frac(*CELL)
    cols = {f"f2c_{i}{j}": f2c[i][j] for i in range(3) for j in range(3)} | {f"c2f_{i}{j}": c2f[i][j] for i in range(3) for j in range(3)}
    out = crystals.withColumns(cols | {"volume": g.cell_volume(*CELL)})
    if "mol_volume" in out.columns:
        out = out.withColumn("packing", g.packing_coefficient("mol_volume", "sym_mult", "volume"))
    return out.withColumn("density", g.density("mass", "sym_mult", "volume")) if "mass" in out.columns else out


def matrix(prefix: str):
    return tuple(tuple(F.col(f"{prefix}_{i}{j}") for j in range(3)) for i in range(3))


def pose(atoms: DataFrame, crystals: DataFrame, key: str = "crystal") -> DataFrame:
    """Molecules (key, atom, x, y, z) centred, mirrored along x if hand is -1, turned by the crystal's rotation vector (ox, oy, oz), and moved to the fractional centroid (fx, fy, fz)."""
    c = with_cell(crystals)
    rows = atoms.join(centroids(atoms, key), key).join(c, key)
    v = tuple(F.col(a) - F.col(f"c_{a}") for a in "xyz")
    hand = F.coalesce("hand", F.lit(1)).cast("double") if "hand" in crystals.columns else F.lit(1.0)
    turned = g.matvec(g.rotation_matrix(g.vec("ox", "oy", "oz")), (v[0] * hand, v[1], v[2]))
    place = g.matvec(matrix("f2c"), g.vec("fx", "fy", "fz"))
    return rows.withColumns({a: t + p for a, t, p in zip("xyz", turned, place, strict=True)}).select(*atoms.columns)


def unit_cell(atoms: DataFrame, crystals: DataFrame, ops: DataFrame, key: str = "crystal") -> DataFrame:
    """All symmetry images of posed molecules: (key, image, atom, x, y, z). ops: (sg_ind, op, r11..r33, t1..t3)."""
    c = with_cell(crystals)
    images = symmetry_images(c, ops)
    home = images.select(key, "op", *(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)), *(F.col(f"f{x}").alias(f"i{x}") for x in "xyz"), *(f"f2c_{i}{j}" for i in range(3) for j in range(3)), *(f"c2f_{i}{j}" for i in range(3) for j in range(3)))
    rows = atoms.join(centroids(atoms, key), key).join(home, key)
    rel = g.matvec(matrix("c2f"), tuple(F.col(a) - F.col(f"c_{a}") for a in "xyz"))
    turned = g.matvec(tuple(tuple(F.col(f"r{i}{j}") for j in (1, 2, 3)) for i in (1, 2, 3)), rel)
    out = g.matvec(matrix("f2c"), tuple(t + F.col(f"i{x}") for t, x in zip(turned, "xyz", strict=True)))
    return rows.withColumns(dict(zip("xyz", out, strict=True))).select(key, F.col("op").alias("image"), *[c for c in atoms.columns if c != key])


def cluster(cell_atoms: DataFrame, crystals: DataFrame, cutoff: float, key: str = "crystal", most: int = 8) -> DataFrame:
    """Images of the unit cell's molecules near the first one: adds mol (copy) and aux: 0 the molecule itself, 1 near, and none beyond cutoff + 2 radius + 0.1.

    Whole molecules are kept or left out by their centroids, before any atom is copied. Each axis gets the shifts that
    the reach, the spacing of its planes and the image's offset need (``most`` is checked, never cut off).
    """
    c = with_cell(crystals).select(key, *(f"{f}_{i}{j}" for f in ("f2c", "c2f") for i in range(3) for j in range(3)))
    mol = centroids(cell_atoms.withColumn("_m", F.struct(key, "image")), "_m").select(F.col(f"_m.{key}").alias(key), F.col("_m.image").alias("image"), "c_x", "c_y", "c_z")
    first = mol.groupBy(key).agg(F.min_by(F.struct("c_x", "c_y", "c_z"), "image").alias("o"), F.min("image").alias("first"))
    size = radii(cell_atoms.withColumn("_m", F.struct(key, "image")), "_m").groupBy(F.col(f"_m.{key}").alias(key)).agg(F.max("radius").alias("radius"))
    grid = mol.join(c, key).join(first, key).join(size, key)
    reach = cutoff + 2 * F.col("radius") + 0.1
    offset = g.matvec(matrix("c2f"), tuple(F.col(f"c_{x}") - F.col(f"o.c_{x}") for x in "xyz"))
    wide = [reach * g.norm(row) + 1e-9 for row in matrix("c2f")]
    grid = grid.withColumns({f"lo{k}": F.ceil(-wide[k] - offset[k]).cast("int") for k in range(3)} | {f"hi{k}": F.floor(wide[k] - offset[k]).cast("int") for k in range(3)})
    ok = F.assert_true(F.greatest(*(F.abs(f"{e}{k}") for e in ("lo", "hi") for k in range(3))) <= most, F.lit(f"a cell needs more than {most} shifts along an axis"))
    grid = grid.withColumn("_ok", ok).filter(F.col("_ok").isNull() & (F.col("lo0") <= F.col("hi0")) & (F.col("lo1") <= F.col("hi1")) & (F.col("lo2") <= F.col("hi2")))
    for k in range(3):
        grid = grid.withColumn(f"n{k}", F.explode(F.sequence(f"lo{k}", f"hi{k}")))
    move = g.matvec(matrix("f2c"), tuple(F.col(f"n{k}").cast("double") for k in range(3)))
    at = tuple(F.col(f"c_{x}") + m - F.col(f"o.c_{x}") for x, m in zip("xyz", move, strict=True))
    same = (F.col("image") == F.col("first")) & (F.abs("n0") + F.abs("n1") + F.abs("n2") == 0)
    near = grid.filter(same | (g.norm(at) < reach))
    near = near.select(key, "image", "n0", "n1", "n2", *(m.alias(f"m{x}") for x, m in zip("xyz", move, strict=True)), F.when(same, 0).otherwise(1).alias("aux"))
    out = cell_atoms.join(near, [key, "image"]).withColumns({x: F.col(x) + F.col(f"m{x}") for x in "xyz"})
    return out.drop("mx", "my", "mz")


def reparametrise(cell_atoms: DataFrame, crystals: DataFrame, boxes: DataFrame, key: str = "crystal", eps: float = 1e-6) -> DataFrame:
    """(key, image, fx, fy, fz, well_defined): the image in the asymmetric unit. None there: the nearest to the origin, not well defined; several: the nearest, ties by x, y, z."""
    c = with_cell(crystals).join(F.broadcast(boxes.select("sg_ind", "ax", "ay", "az")), "sg_ind")
    mol = centroids(cell_atoms.withColumn("_m", F.struct(key, "image")), "_m").select(F.col(f"_m.{key}").alias(key), F.col("_m.image").alias("image"), "c_x", "c_y", "c_z")
    rows = mol.join(c.select(key, "ax", "ay", "az", *(f"c2f_{i}{j}" for i in range(3) for j in range(3))), key)
    f = g.matvec(matrix("c2f"), g.vec("c_x", "c_y", "c_z"))
    rows = rows.withColumns({f"f{x}": v - F.floor(v) for x, v in zip("xyz", f, strict=True)})
    inside = g.in_box(g.vec("fx", "fy", "fz"), g.vec("ax", "ay", "az"), eps)
    rows = rows.withColumn("in", inside).withColumn("n", F.sum(F.col("in").cast("int")).over(Window.partitionBy(key)))
    d2 = F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + F.col("fz") * F.col("fz")
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("in"), F.round(d2, 9), "fx", "fy", "fz", "image"))
    return rows.withColumn("_r", best).filter("_r = 1").select(key, "image", "fx", "fy", "fz", (F.col("n") == 1).alias("well_defined"))


def handedness(axes):
    """+1 or -1: whether three axes (rows) are right- or left-handed; 0 where they are flat."""
    return F.signum(g.determinant(axes)).cast("int")


def principal_frame(atoms: DataFrame, key: str) -> DataFrame:
    """(key, ox, oy, oz, hand): the turn that brings a molecule from its standard axes to where it is, with z >= 0, and the handedness of its principal axes.

    The standard form has the principal axes as x, y and z, each towards the farthest atom; a left-handed molecule is mirrored along x there.
    """
    axes = principal_axes(atoms, key).select(key, *(F.col("axes")[k][i].alias(f"_a{k}{i}") for k in range(3) for i in range(3)))
    rows = tuple(tuple(F.col(f"_a{k}{i}") for i in range(3)) for k in range(3))
    axes = axes.withColumn("hand", handedness(rows))
    # Columns of the turn are the images of x (of -x for a left-handed molecule), y and z.
    turn = tuple((rows[0][i] * F.col("hand"), rows[1][i], rows[2][i]) for i in range(3))
    # Step by step, as one expression would hold the matrix hundreds of times.
    axes = axes.withColumns({f"_t_{i}{j}": turn[i][j] for i in range(3) for j in range(3)})
    axes = axes.withColumns({f"_v{x}": v for v, x in zip(g.rotation_vector(matrix("_t")), "xyz", strict=True)})
    return axes.select(key, *(v.alias(f"o{x}") for v, x in zip(g.canonical_rotvec(g.vec("_vx", "_vy", "_vz")), "xyz", strict=True)), "hand")


def standard_form(atoms: DataFrame, key: str) -> DataFrame:
    """Atoms in their molecule's principal axes, centred."""
    axes = principal_axes(atoms, key).select(key, "axes")
    rows = atoms.join(centroids(atoms, key), key).join(axes, key)
    v = tuple(F.col(a) - F.col(f"c_{a}") for a in "xyz")
    new = {a: g.dot(tuple(F.col("axes")[k][i] for i in range(3)), v) for k, a in enumerate("xyz")}
    return rows.withColumns(new).select(*atoms.columns)


def parameters(cell_atoms: DataFrame, crystals: DataFrame, boxes: DataFrame, key: str = "crystal") -> DataFrame:
    """What ``reparametrise`` finds, with the orientation (ox, oy, oz) and handedness of the image in the asymmetric unit."""
    found = reparametrise(cell_atoms, crystals, boxes, key)
    home = cell_atoms.join(found.select(key, "image"), [key, "image"], "left_semi")
    return found.join(principal_frame(home, key), key)


def random_crystals(molecules: DataFrame, key: str, seed: int, sg_ind: int = 1) -> DataFrame:
    """Seeded random parameters by key: lengths to a packing near 0.62, angles near 90 degrees, uniform centroids and turns."""
    def u(name):
        return hashed_uniform(F.lit(seed), F.lit(name), F.col(key))

    def n(name):
        return uniform_to_normal(u(name))

    raw = molecules.withColumn("sg_ind", F.lit(sg_ind)).withColumns({a: F.exp(0.3 * n(a)) for a in "abc"} | {a: math.pi / 2 + 0.1 * n(a) for a in ("alpha", "beta", "gamma")})
    raw = raw.withColumn("system", crystal_system("sg_ind"))
    raw = raw.withColumns(g.enforce_system("system", *CELL))
    target = F.col("mol_volume") * F.col("sym_mult") / F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.6226 + 0.0447 * n("packing")))
    k = F.pow(target / g.cell_volume(*CELL), 1 / 3)
    raw = raw.withColumn("_k", k).withColumns({a: F.col(a) * F.col("_k") for a in "abc"}).drop("_k")
    theta, phi, r = F.acos(u("theta")), 2 * math.pi * u("phi"), math.pi + 0.5 * n("turn")
    turn = g.from_spherical(theta, phi, r)
    return raw.withColumns({f"f{x}": u(f"f{x}") for x in "xyz"} | {f"o{x}": v for x, v in zip("xyz", turn, strict=True)} | {"hand": F.when(u("hand") < 0.5, -1).otherwise(1)})


def best_attempt(molecules: DataFrame, key: str, score, attempts: int, seed: int) -> DataFrame:
    """The best of seeded random attempts for each key; all attempts are scored in one pass. score: DataFrame -> DataFrame with ``score``."""
    tries = molecules.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("_try", F.concat_ws("#", key, "attempt"))
    scored = score(random_crystals(tries, "_try", seed)).drop("_try")
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("score", "attempt"))).filter("_r = 1").drop("_r")


def noised(crystals: DataFrame, key: str, columns: list[str], scale: float, seed: int) -> DataFrame:
    """Seeded Gaussian noise on parameters."""
    return crystals.withColumns({c: F.col(c) + scale * uniform_to_normal(hashed_uniform(F.lit(seed), F.lit(c), F.col(key))) for c in columns})


def fold_to_least(candidates: DataFrame, key: str, columns: tuple[str, ...] = ("fx", "fy", "fz", "ox", "oy", "oz"), digits: int = 6) -> DataFrame:
    """The candidate of each key that is least column by column, values rounded first; rows with ``valid`` false don't take part."""
    ok = candidates.filter("valid") if "valid" in candidates.columns else candidates
    order = F.struct(*(F.round(F.col(c), digits).alias(c) for c in columns))
    rest = [c for c in ok.columns if c != key]
    return ok.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(key, "_b.*")


def coset_images(crystals: DataFrame, operators: DataFrame, key: str = "sg_ind") -> DataFrame:
    """Centroids and orientations under each operator of a normaliser's cosets, the identity included, with ``valid``: proper, or the molecule isn't chiral.

    Where crystals have a cell (f2c, c2f) and a rotation vector (ox, oy, oz), the operator turns it too: its part in the laboratory frame, made
    proper, times the rotation. An improper operator changes the sign of ``hand``.
    """
    met = symmetry_images(crystals, operators, key)
    m = tuple(tuple(F.col(f"r{i}{j}") for j in (1, 2, 3)) for i in (1, 2, 3))
    if {"ox", "oy", "oz", "f2c_00", "c2f_00"} <= set(crystals.columns):
        lab = g.matmul(matrix("f2c"), g.matmul(m, matrix("c2f")))
        sign = F.when(g.determinant(m) < 0, -1.0).otherwise(1.0)
        proper = tuple(tuple(sign * x for x in row) for row in lab)
        turned = g.rotation_vector(g.matmul(proper, g.rotation_matrix(g.vec("ox", "oy", "oz"))))
        met = met.withColumns({f"o{x}": v for x, v in zip("xyz", turned, strict=True)})
        if "hand" in crystals.columns:
            met = met.withColumn("hand", F.col("hand") * sign.cast("int"))
    chiral = F.col("chiral") if "chiral" in crystals.columns else F.lit(True)
    return met.withColumn("valid", (g.determinant(m) > 0) | ~chiral)


def free_axes_zeroed(crystals: DataFrame, free: DataFrame, key: str = "sg_ind") -> DataFrame:
    """Centroid coordinates along a group's free axes set to 0. free: (sg_ind, free_x, free_y, free_z)."""
    met = crystals.join(F.broadcast(free), key, "left")
    return met.withColumns({f"f{a}": F.when(F.coalesce(f"free_{a}", F.lit(False)), 0.0).otherwise(F.col(f"f{a}")) for a in "xyz"}).drop("free_x", "free_y", "free_z")


def rebuild_matches(original: DataFrame, rebuilt: DataFrame, cutoff: float, *, key: str = "crystal", worst: float = 5e-2, mean: float = 1e-2) -> DataFrame:
    """(crystal, ok): nearest rebuilt atom of each original one: worst and mean distance in bounds, and no atom taken twice."""
    e = radius_join(original, rebuilt, cutoff, group=key, point="atom")
    near = e.groupBy(key, "i").agg(F.min_by("j", F.struct("dist", "j")).alias("j"), F.min("dist").alias("dist"))
    n = original.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    got = near.groupBy(key).agg(F.max("dist").alias("worst"), F.avg("dist").alias("mean"), F.countDistinct("j").alias("distinct"))
    ok = (F.col("worst") < worst) & (F.col("mean") < mean) & (F.col("distinct") == F.col("n"))
    return n.join(got, key, "left").select(key, F.coalesce(ok, F.lit(False)).alias("ok"))


def into_box(atoms: DataFrame, crystals: DataFrame, key: str = "crystal", molecule: str = "mol") -> DataFrame:
    """Whole molecules moved by lattice vectors so that their centroids lie in the cell."""
    c = with_cell(crystals).select(key, *(f"f2c_{i}{j}" for i in range(3) for j in range(3)), *(f"c2f_{i}{j}" for i in range(3) for j in range(3)))
    m = atoms.groupBy(key, molecule).agg(*(F.avg(a).alias(f"c_{a}") for a in "xyz")).join(c, key)
    f = g.matvec(matrix("c2f"), g.vec("c_x", "c_y", "c_z"))
    move = g.matvec(matrix("f2c"), tuple(-F.floor(x).cast("double") for x in f))
    m = m.select(key, molecule, *(x.alias(f"m{a}") for a, x in zip("xyz", move, strict=True)))
    return atoms.join(m, [key, molecule]).withColumns({a: F.col(a) + F.col(f"m{a}") for a in "xyz"}).drop("mx", "my", "mz")
