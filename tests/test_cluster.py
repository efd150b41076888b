"""Clusters hold all molecules in reach, however small or skewed the cell."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.functions import tables as tb
from stratalith.operators import crystal as cr


def built(spark):
    cells = [(1, 3.0, 4.0, 5.0, 1.5, 1.5, 1.5), (2, 2.5, 9.0, 3.0, 1.2, 1.7, 1.3), (3, 20.0, 20.0, 20.0, 1.5, 1.5, 1.5)]
    crystals = spark.createDataFrame([(*c, 2, 0.4, 0.1, 0.3, 0.2, 0.1, 0.5) for c in cells], "crystal long, a double, b double, c double, alpha double, beta double, gamma double, sg_ind int, fx double, fy double, fz double, ox double, oy double, oz double")
    atoms = spark.createDataFrame([(c[0], k, 0.5 * k, 0.3 * k * k, 0.0) for c in cells for k in range(3)], "crystal long, atom int, x double, y double, z double")
    ops = spark.createDataFrame([(2, 0, "x,y,z"), (2, 1, "-x,-y,-z")], "sg_ind int, op int, s string")
    ops = ops.select("sg_ind", "op", *(e.alias(k) for k, e in tb.parse_symmetry(F.col("s")).items()))
    return cells, crystals, cr.unit_cell(cr.pose(atoms, crystals), crystals, ops)


def test_all_images_in_reach(spark):
    cells, crystals, cell = built(spark)
    near = {(r.crystal, r.image, r.n0, r.n1, r.n2) for r in cr.cluster(cell, crystals, 7.0).collect()}
    rows = cell.collect()
    want = set()
    for key, a, b, c, al, be, ga in cells:
        x = (math.cos(al) - math.cos(be) * math.cos(ga)) / math.sin(ga)
        m = np.array([[a, b * math.cos(ga), c * math.cos(be)], [0, b * math.sin(ga), c * x], [0, 0, c * math.sqrt(1 - math.cos(be) ** 2 - x * x)]])
        at = {i: np.array([[r.x, r.y, r.z] for r in rows if (r.crystal, r.image) == (key, i)]) for i in (0, 1)}
        middle = {i: v.mean(0) for i, v in at.items()}
        reach = 7.1 + 2 * max(np.linalg.norm(v - v.mean(0), axis=1).max() for v in at.values())
        for i, n in product((0, 1), product(range(-7, 8), repeat=3)):
            if np.linalg.norm(middle[i] + m @ n - middle[0]) < reach:
                want.add((key, i, *n))
    assert near == want
    assert max(abs(n) for _, _, *shift in near for n in shift) > 2


def test_too_small_cells_raise(spark):
    _, crystals, cell = built(spark)
    with pytest.raises(Exception, match="needs more than 1 shifts"):
        cr.cluster(cell, crystals, 4.0, most=1).collect()
