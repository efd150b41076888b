"""Cells, rotations and internal coordinates as column expressions. A vector is a tuple of three columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import d, relu

Vec = tuple[Column, Column, Column]


def vec(*names) -> Vec:
    return tuple(d(n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def matvec(m: tuple[Vec, Vec, Vec], v: Vec) -> Vec:
    return tuple(dot(row, v) for row in m)


def matmul(a, b) -> tuple[Vec, Vec, Vec]:
    columns = list(zip(*b, strict=True))
    return tuple(tuple(dot(row, col) for col in columns) for row in a)


def determinant(m) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def trace(m) -> Column:
    return m[0][0] + m[1][1] + m[2][2]


# Cells. Angles are radians.


def cell_factor(alpha, beta, gamma) -> Column:
    ca, cb, cg = F.cos(d(alpha)), F.cos(d(beta)), F.cos(d(gamma))
    return 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg


def cell_volume(a, b, c, alpha, beta, gamma) -> Column:
    return d(a) * d(b) * d(c) * F.sqrt(F.abs(cell_factor(alpha, beta, gamma)))


def frac_to_cart(a, b, c, alpha, beta, gamma) -> tuple[Vec, Vec, Vec]:
    """Upper triangular matrix from fractional to Cartesian coordinates."""
    ca, cb, cg, sg = F.cos(d(alpha)), F.cos(d(beta)), F.cos(d(gamma)), F.sin(d(gamma))
    v = cell_volume(a, b, c, alpha, beta, gamma)
    zero = F.lit(0.0)
    return (d(a), d(b) * cg, d(c) * cb), (zero, d(b) * sg, d(c) * (ca - cb * cg) / sg), (zero, zero, v / (d(a) * d(b) * sg))


def cart_to_frac(a, b, c, alpha, beta, gamma) -> tuple[Vec, Vec, Vec]:
    """Inverse of frac_to_cart, by back substitution."""
    m = frac_to_cart(a, b, c, alpha, beta, gamma)
    zero = F.lit(0.0)
    i00, i11, i22 = 1 / m[0][0], 1 / m[1][1], 1 / m[2][2]
    i01, i12 = -m[0][1] * i00 * i11, -m[1][2] * i11 * i22
    return (i00, i01, (m[0][1] * m[1][2] - m[0][2] * m[1][1]) * i00 * i11 * i22), (zero, i11, i12), (zero, zero, i22)


def box_vectors(a, b, c, alpha, beta, gamma) -> tuple[Vec, Vec, Vec]:
    """Cell vectors as rows."""
    m = frac_to_cart(a, b, c, alpha, beta, gamma)
    return tuple(tuple(m[i][j] for i in range(3)) for j in range(3))


#: Fixed value: g/cm3 of one u per cubic Angstrom.
DENSITY = 1.66054


def packing_coefficient(mol_volume, multiplicity, volume) -> Column:
    return d(mol_volume) * d(multiplicity) / d(volume)


def density(mass, multiplicity, volume) -> Column:
    return d(mass) * d(multiplicity) / d(volume) * DENSITY


def lammps_box(xlo, xhi, ylo, yhi, zlo, zhi, xy, xz, yz) -> dict[str, Column]:
    """Lengths and angles of a triclinic dump box from its bounds and tilts."""
    xy, xz, yz = d(xy), d(xz), d(yz)
    lx = d(xhi) - F.greatest(F.lit(0.0), xy, xz, xy + xz) - (d(xlo) - F.least(F.lit(0.0), xy, xz, xy + xz))
    ly = d(yhi) - F.greatest(F.lit(0.0), yz) - (d(ylo) - F.least(F.lit(0.0), yz))
    lz = d(zhi) - d(zlo)
    b, c = F.sqrt(ly * ly + xy * xy), F.sqrt(lz * lz + xz * xz + yz * yz)
    return {"a": lx, "b": b, "c": c, "alpha": F.acos((xy * xz + ly * yz) / (b * c)), "beta": F.acos(xz / c), "gamma": F.acos(xy / b)}


def enforce_system(system, a, b, c, alpha, beta, gamma) -> dict[str, Column]:
    """Lengths and angles that obey a crystal system: equal lengths averaged, fixed angles set."""
    s = F.col(system) if isinstance(system, str) else system
    right, wide = F.lit(math.pi / 2), F.lit(2 * math.pi / 3)
    ab, abc = (d(a) + d(b)) / 2, (d(a) + d(b) + d(c)) / 3
    tet, hexa, cub = s.isin("tetragonal", "trigonal", "hexagonal"), s.isin("trigonal", "hexagonal"), s == "cubic"
    free = s == "triclinic"
    return {
        "a": F.when(tet, ab).when(cub, abc).otherwise(d(a)),
        "b": F.when(tet, ab).when(cub, abc).otherwise(d(b)),
        "c": F.when(cub, abc).otherwise(d(c)),
        "alpha": F.when(free, d(alpha)).otherwise(right),
        "beta": F.when(free | (s == "monoclinic"), d(beta)).otherwise(right),
        "gamma": F.when(free, d(gamma)).when(hexa, wide).otherwise(right),
    }


def reduction_penalty(system, a, b, c, alpha, beta, gamma) -> Column:
    """Squared violations of a reduced cell by crystal system."""
    e = enforce_system(system, a, b, c, alpha, beta, gamma)
    off = sum(((d(x) - e[n]) * (d(x) - e[n]) for x, n in ((a, "a"), (b, "b"), (c, "c"), (alpha, "alpha"), (beta, "beta"), (gamma, "gamma"))), F.lit(0.0))
    s = F.col(system) if isinstance(system, str) else system
    order = relu(d(a) - d(b)) * relu(d(a) - d(b)) + relu(d(b) - d(c)) * relu(d(b) - d(c))
    n = relu(-niggli_overlap(a, b, c, alpha, beta, gamma))
    return off + F.when(s == "triclinic", order + n * n).otherwise(0.0)


def niggli_overlap(a, b, c, alpha, beta, gamma) -> Column:
    return d(a) * d(b) * F.cos(d(gamma)) + d(a) * d(c) * F.cos(d(beta)) + d(b) * d(c) * F.cos(d(alpha))


def niggli_mirror(a, b, c, alpha, beta, gamma) -> Vec:
    """All three angles reflected where the overlap is negative."""
    bad = niggli_overlap(a, b, c, alpha, beta, gamma) < 0
    return tuple(F.when(bad, math.pi - d(x)).otherwise(d(x)) for x in (alpha, beta, gamma))


def wrap_unit(x) -> Column:
    """Into [0, 1); exactly 1 stays."""
    return F.when(d(x) == 1.0, 1.0).otherwise(d(x) - F.floor(d(x)))


def minimum_image(x) -> Column:
    """A fractional difference to the nearest image, ties to even."""
    return d(x) - F.rint(d(x))


def in_box(v: Vec, box: Vec, eps: float = 0.0) -> Column:
    out = F.lit(True)
    for x, b in zip(v, box, strict=True):
        out = out & (x >= 0) & (x <= b + eps)
    return out


# Rotations.


def rotation_matrix(v: Vec) -> tuple[Vec, Vec, Vec]:
    """Rodrigues' formula; the zero vector is no rotation."""
    t = norm(v)
    k = tuple(F.when(t > 0, x / F.when(t > 0, t).otherwise(1.0)).otherwise(0.0) for x in v)
    s, c1 = F.sin(t), 1 - F.cos(t)
    return (
        (1 - c1 * (k[1] * k[1] + k[2] * k[2]), c1 * k[0] * k[1] - s * k[2], c1 * k[0] * k[2] + s * k[1]),
        (c1 * k[0] * k[1] + s * k[2], 1 - c1 * (k[0] * k[0] + k[2] * k[2]), c1 * k[1] * k[2] - s * k[0]),
        (c1 * k[0] * k[2] - s * k[1], c1 * k[1] * k[2] + s * k[0], 1 - c1 * (k[0] * k[0] + k[1] * k[1])),
    )


def rotation_angle(m) -> Column:
    """In [0, pi], from the trace, kept off the ends by 1e-7."""
    return F.acos(F.greatest(F.lit(-1 + 1e-7), F.least(F.lit(1 - 1e-7), (trace(m) - 1) / 2)))


def rotation_vector(m) -> Vec:
    """Axis times angle: zero for the identity; a half turn's axis comes from the symmetric part, its first component that isn't zero positive."""
    raw = (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
    n = norm(raw)
    flat = n < 1e-7
    t = F.atan2(n / 2, (trace(m) - 1) / 2)
    # (m + 1) / 2 of a half turn is the axis times itself; the column of its largest diagonal entry gives the axis.
    half = tuple(tuple((m[i][j] + m[j][i]) / 4 + (0.5 if i == j else 0.0) for j in range(3)) for i in range(3))
    first = (half[0][0] >= half[1][1]) & (half[0][0] >= half[2][2])
    pick = [F.when(first, half[i][0]).when(half[1][1] >= half[2][2], half[i][1]).otherwise(half[i][2]) for i in range(3)]
    length = norm(tuple(pick))
    lead = F.when(F.abs(pick[0]) > 1e-7, pick[0]).when(F.abs(pick[1]) > 1e-7, pick[1]).otherwise(pick[2])
    sign = F.when(lead < 0, -math.pi).otherwise(math.pi)
    turn = [F.when(length > 0, p / F.when(length > 0, length).otherwise(1.0) * sign).otherwise(0.0) for p in pick]
    return tuple(F.when(~flat, x / F.when(flat, 1.0).otherwise(n) * t).when(trace(m) > 1, 0.0).otherwise(h) for x, h in zip(raw, turn, strict=True))


def canonical_rotvec(v: Vec) -> Vec:
    """The same rotation with z >= 0: -v (2 pi - |v|) / |v| where z is negative."""
    n = norm(v)
    k = -(2 * math.pi - n) / F.when(n > 0, n).otherwise(1.0)
    return tuple(F.when(v[2] < 0, x * k).otherwise(x) for x in v)


def to_spherical(v: Vec) -> tuple[Column, Column, Column]:
    """(theta from z, phi, r); theta of the zero vector is 0."""
    r = norm(v)
    return F.acos(F.when(r > 0, v[2] / F.when(r > 0, r).otherwise(1.0)).otherwise(1.0)), F.atan2(v[1], v[0]), r


def from_spherical(theta, phi, r) -> Vec:
    return d(r) * F.sin(d(theta)) * F.cos(d(phi)), d(r) * F.sin(d(theta)) * F.sin(d(phi)), d(r) * F.cos(d(theta))


def angle_of(sine, cosine) -> Column:
    return F.atan2(d(sine), d(cosine))


def circular_difference(a, b, period: float = 2.0) -> Column:
    """a - b wrapped into [-period / 2, period / 2)."""
    return F.pmod(d(a) - d(b) + period / 2, F.lit(period)) - period / 2


# Internal coordinates.


def bond_length(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def bond_angle(a: Vec, b: Vec, c: Vec) -> Column:
    """At b, by atan2, which is exact near 0 and pi."""
    u, v = sub(a, b), sub(c, b)
    return F.atan2(norm(cross(u, v)), dot(u, v))


def dihedral(a: Vec, b: Vec, c: Vec, e: Vec) -> Column:
    u, v, w = sub(b, a), sub(c, b), sub(e, c)
    m, n = cross(u, v), cross(v, w)
    return F.atan2(norm(v) * dot(u, n), dot(m, n))


def wilson_angle(a: Vec, b: Vec, c: Vec, centre: Vec) -> Column:
    """Out-of-plane angle of a against the plane of b and c through the centre."""
    u, v, w = sub(a, centre), sub(b, centre), sub(c, centre)
    n = cross(v, w)
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, n) / (norm(u) * norm(n)))))


def place_next(a: Vec, b: Vec, c: Vec, length, angle, torsion) -> Vec:
    """The point at ``length`` from c, ``angle`` to b and ``torsion`` to a (natural extension)."""
    bc = sub(c, b)
    bc = scale(bc, 1 / norm(bc))
    n = cross(sub(b, a), bc)
    n = scale(n, 1 / norm(n))
    m = cross(n, bc)
    x, y, z = -d(length) * F.cos(d(angle)), d(length) * F.sin(d(angle)) * F.cos(d(torsion)), d(length) * F.sin(d(angle)) * F.sin(d(torsion))
    return tuple(c[i] + bc[i] * x + m[i] * y + n[i] * z for i in range(3))


def ellipsoid_volume(p, q, r) -> Column:
    return 4 / 3 * math.pi * d(p) * d(q) * d(r)


def sphere_volume(r) -> Column:
    return 4 / 3 * math.pi * d(r) * d(r) * d(r)


def lens_volume(r1, r2, dist) -> Column:
    """Overlap of two spheres; 0 apart, the smaller sphere when one holds the other."""
    a, b, x = d(r1), d(r2), d(dist)
    s = a + b - x
    lens = math.pi * s * s * (x * x + 2 * x * (a + b) - 3 * (a - b) * (a - b)) / (12 * F.when(x > 0, x).otherwise(1.0))
    return F.when(x >= a + b, 0.0).when(x <= F.abs(a - b), sphere_volume(F.least(a, b))).otherwise(lens)


# Array columns of any width.


def array_dot(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def array_distance2(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def latent_distance(x, y, angular_from: int) -> Column:
    """Euclidean, with dimensions from ``angular_from`` (0-based) wrapped to a period of 2."""
    diff = F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))
    diff = F.transform(diff, lambda v, i: F.when(i >= angular_from, F.pmod(v + 1, F.lit(2.0)) - 1).otherwise(v))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v))
