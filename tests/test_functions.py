"""Closed forms and round trips of scalar and geometry functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stratalith.functions import geometry as g
from stratalith.functions import scalars as m
from stratalith.functions import tables as tb


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def lits(*xs):
    return tuple(F.lit(float(x)) for x in xs)


def test_cube_volume_and_inverse(spark):
    cell = lits(4, 4, 4, math.pi / 2, math.pi / 2, math.pi / 2)
    got = one(spark, v=g.cell_volume(*cell))
    assert got["v"] == pytest.approx(64)
    cell = lits(5, 6, 7, 1.3, 1.5, 1.8)
    v = lits(0.2, 0.3, 0.9)
    back = g.matvec(g.cart_to_frac(*cell), g.matvec(g.frac_to_cart(*cell), v))
    got = one(spark, x=back[0], y=back[1], z=back[2])
    assert list(got.values()) == pytest.approx([0.2, 0.3, 0.9])


def test_box_vectors_keep_lengths_and_angles(spark):
    cell = lits(5, 6, 7, 1.3, 1.5, 1.8)
    a, b, c = g.box_vectors(*cell)
    got = one(spark, b=g.norm(b), c=g.norm(c), alpha=F.acos(g.dot(b, c) / (g.norm(b) * g.norm(c))), gamma=F.acos(g.dot(a, b) / (g.norm(a) * g.norm(b))))
    assert list(got.values()) == pytest.approx([6, 7, 1.3, 1.8])


def test_rotation_round_trip(spark):
    v = lits(0.3, -0.4, 1.1)
    back = g.rotation_vector(g.rotation_matrix(v))
    same = g.rotation_matrix(g.canonical_rotvec(lits(0.3, 0.4, -1.1)))
    plain = g.rotation_matrix(lits(0.3, 0.4, -1.1))
    got = one(spark, x=back[0], y=back[1], z=back[2], d=F.abs(same[0][1] - plain[0][1]), t=g.trace(g.rotation_matrix(lits(0, 0, 0))))
    assert [got[k] for k in "xyz"] == pytest.approx([0.3, -0.4, 1.1])
    assert got["d"] < 1e-9 and got["t"] == pytest.approx(3)


def test_placing_an_atom_gives_its_coordinates(spark):
    a, b, c = lits(0, 0, 0), lits(1.5, 0, 0), lits(2, 1.4, 0)
    e = g.place_next(a, b, c, F.lit(1.1), F.lit(1.9), F.lit(0.7))
    got = one(spark, r=g.bond_length(e, c), t=g.bond_angle(e, c, b), p=g.dihedral(a, b, c, e))
    assert list(got.values()) == pytest.approx([1.1, 1.9, 0.7])


def test_dump_box(spark):
    got = one(spark, **g.lammps_box(*lits(0, 12, 0, 11, 0, 10, 1, 0.5, 0.25)))
    lx, ly = 12 - 1.5, 11 - 0.25
    assert got["a"] == pytest.approx(lx) and got["b"] == pytest.approx(math.hypot(ly, 1))


@pytest.mark.parametrize("x", [-3.0, -0.5, 0.0, 0.2, 4.0])
def test_inverses(spark, x):
    c = F.lit(x)
    got = one(
        spark, a=m.invert_softplus_shift(m.softplus_shift(F.lit(abs(x) + 0.1))), b=m.inverse_sigmoid_shift(m.sigmoid_shift(c, 2, 5), 2, 5),
        c=m.undo_bound(m.enforce_bound(F.lit(x / 4), 0.0, 2.0), 0.0, 2.0), d=m.uniform_to_normal(m.normal_to_uniform(F.lit(x / 2))),
    )
    assert got["a"] == pytest.approx(abs(x) + 0.1, abs=1e-6) and got["b"] == pytest.approx(x, abs=1e-9)
    assert got["c"] == pytest.approx(x / 4) and got["d"] == pytest.approx(x / 2, abs=2e-3)


def test_sanitised_values(spark):
    got = one(spark, a=m.finite(F.lit(float("nan"))), b=m.finite(F.lit(float("inf"))), c=m.finite(F.lit(float("-inf"))), d=m.finite(F.lit(2.0)))
    assert list(got.values()) == [0.0, 1e20, -1e-20, 2.0]


def test_identifiers(spark):
    got = one(spark, a=m.family(F.lit("ABCDEF01")), b=m.family(F.lit("ABCDEF")), c=m.first_target(F.lit("target_XXII"), ["II", "XXII"]), d=m.pair_index(F.lit(1), F.lit(0), 3))
    assert got == {"a": "ABCDEF", "b": "ABCDEF", "c": "XXII", "d": 1}


def test_symmetry_operators(spark):
    got = one(spark, **tb.parse_symmetry(F.lit("-x, 1/2+y, z-1/4")))
    assert (got["r11"], got["r22"], got["r33"], got["t1"], got["t2"], got["t3"]) == (-1.0, 1.0, 1.0, 0.0, 0.5, -0.25)


def test_systems(spark):
    rows = {r["sg_ind"]: r["system"] for r in tb.space_groups(spark).collect()}
    assert len(rows) == 230 and [rows[i] for i in (2, 3, 74, 75, 143, 194, 195)] == ["triclinic", "monoclinic", "orthorhombic", "tetragonal", "trigonal", "hexagonal", "cubic"]
    assert tb.elements(spark).filter("symbol = 'C'").first()["vdw_radius"] == 1.7


def test_spheres(spark):
    got = one(spark, apart=g.lens_volume(F.lit(1.0), F.lit(1.0), F.lit(3.0)), inside=g.lens_volume(F.lit(2.0), F.lit(1.0), F.lit(0.5)), half=g.lens_volume(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert got["apart"] == 0 and got["inside"] == pytest.approx(4 / 3 * math.pi) and got["half"] == pytest.approx(5 * math.pi / 12)


def test_rotation_vectors_of_flat_matrices(spark):
    """The identity has no turn; half turns keep their axis."""
    eye = tuple(tuple(F.lit(float(i == j)) for j in range(3)) for i in range(3))
    row = spark.range(1).select(*(x.alias(a) for a, x in zip("abc", g.rotation_vector(eye), strict=True))).first()
    assert tuple(row) == (0.0, 0.0, 0.0)
    for axis in ((1.0, 0.0, 0.0), (0.0, 0.6, -0.8), (0.48, 0.6, 0.64)):
        m = tuple(tuple(F.lit(2 * axis[i] * axis[j] - (i == j)) for j in range(3)) for i in range(3))
        got = spark.range(1).select(*(x.alias(a) for a, x in zip("abc", g.rotation_vector(m), strict=True))).first()
        assert got == pytest.approx([math.pi * x for x in axis], abs=1e-6)


def test_inverse_normal_is_close(spark):
    from statistics import NormalDist

    us = [1e-5, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.77, 0.98, 0.9999]
    got = [r.z for r in spark.createDataFrame([(u,) for u in us], "u double").select(m.uniform_to_normal("u").alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(u) for u in us], abs=1e-7)
