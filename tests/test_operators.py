"""Operators against brute force, and their edge cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.functions import geometry as g
from stratalith.operators import aggregates as agg
from stratalith.operators import clustering as cl
from stratalith.operators import conformers as cf
from stratalith.operators import filters as fl
from stratalith.operators import iterate as it
from stratalith.operators import joins as jn
from stratalith.operators import layout as lay
from stratalith.operators import plugins as pg
from stratalith.operators import windows as wn
from stratalith.plans import catalog
from stratalith.sources import text as tx


def cloud(spark, n=80, groups=3, seed=1):
    rng = random.Random(seed)
    rows = [(i % groups, i, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "graph int, point int, x double, y double, z double")


@pytest.mark.parametrize("cutoff", [0.5, 1.3])
def test_radius_join(spark, cutoff):
    rows, df = cloud(spark)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and math.dist(a[2:], b[2:]) <= cutoff}
    assert {(r.i, r.j) for r in jn.radius_join(df, df, cutoff, group="graph").collect()} == want


@pytest.mark.parametrize("cell,cutoff", [([[3, 0, 0], [0, 3, 0], [0, 0, 3]], 1.5), ([[3, 0, 0], [1.2, 2.5, 0], [0.4, 0.7, 2.2]], 2.0), ([[6, 0, 0], [0, 6, 0], [0, 0, 1.1]], 1.9)])
def test_periodic_neighbours(spark, cell, cutoff):
    rng = np.random.default_rng(3)
    pos = rng.uniform(-4, 4, (6, 3))
    cell = np.array(cell, float)
    want = set()
    for i in range(6):
        for j in range(6):
            for s in np.ndindex(19, 19, 19):
                s = np.array(s) - 9
                if np.linalg.norm(pos[j] + s @ cell - pos[i]) < cutoff and (i != j or s.any()):
                    want.add((i, j, *s.tolist()))
    atoms = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pos)], "graph int, point int, x double, y double, z double")
    cells = spark.createDataFrame([(0, *map(float, cell.ravel()))], "graph int, " + ", ".join(f"{r}{x} double" for r in "abc" for x in "xyz"))
    got = {(r.i, r.j, r.sx, r.sy, r.sz) for r in jn.periodic_neighbours(atoms, cells, cutoff).collect()}
    assert got == want


def test_too_many_shifts_raise(spark):
    atoms = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "graph int, point int, x double, y double, z double")
    cells = spark.createDataFrame([(0, 0.1, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 3.0)], "graph int, " + ", ".join(f"{r}{x} double" for r in "abc" for x in "xyz"))
    with pytest.raises(Exception, match="more than 8 shifts"):
        jn.periodic_neighbours(atoms, cells, 2.0).collect()


def test_nearest_value(spark):
    rng = random.Random(5)
    t = [(i, round(rng.uniform(0, 20), 1)) for i in range(60)]
    q = [(i, round(rng.uniform(-5, 30), 1)) for i in range(40)]
    got = {r.q: r.k for r in jn.nearest_value_join(spark.createDataFrame(q, "q int, v double"), spark.createDataFrame(t, "k int, w double"), "v", "w", "k", "q").collect()}
    for i, v in q:
        best = min(abs(v - w) for _, w in t)
        assert abs(dict(t)[got[i]] - v) == pytest.approx(best, abs=1e-9)


def test_greedy_anchors(spark):
    rows, df = cloud(spark, 120, 1)
    conflicts = jn.radius_join(df, df, 0.9, group=None).filter("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    kept = []
    best = min(rows, key=lambda r: (r[2], r[1]))
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if (r[1] % 4 == 0 or r is best) and all(math.dist(r[2:], k[2:]) > 0.9 for k in kept):
            kept.append(r)
    got = cl.greedy_anchors(df, conflicts, "x", "point", F.col("point") % 4 == 0)
    assert sorted(r.point for r in got.collect()) == sorted(k[1] for k in kept)


def test_average_linkage(spark):
    xs = [0.0, 0.1, 0.25, 5.0, 5.1, 9.0]
    pts = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, s double")
    d = spark.createDataFrame([(i, j, abs(xs[i] - xs[j])) for i in range(6) for j in range(i)], "a int, b int, dist double")
    got = {r.k: (r.cluster, r.best) for r in cl.average_linkage(pts, d.filter("dist < 0.3"), d, "k", "s", 0.3).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (3, 3), 4: (3, 3), 5: (5, 5)}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a int, b int")
    got = {r.node: r.root for r in cl.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50


def test_filters(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "k int, v double")
    assert [r.k for r in fl.filter_conditions(df, [("v", "range", (0.0, 2.0))]).collect()] == [1]
    assert [r.k for r in fl.filter_conditions(df, [("v", "range", (0.0, 2.0))], keep_nan=True).collect()] == [1, 2]
    with pytest.raises(ValueError):
        fl.filter_conditions(df, [("v", "range", (2.0, 2.0))])
    with pytest.raises(ValueError):
        fl.filter_conditions(df, [("missing", "in", [1])])
    assert fl.copies_of(df, F.col("k") == 1, 3).count() == 3


def test_dense_reduce_and_offsets(spark):
    groups = spark.createDataFrame([(0,), (1,), (2,)], "g int")
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (2, 5.0)], "g int, v double")
    assert {r.g: r.value for r in agg.dense_reduce(groups, rows, "g", "v").collect()} == {0: 3.0, 1: 0.0, 2: 5.0}
    n = spark.createDataFrame([(i, i % 3) for i in range(50)], "g int, n int")
    got = {r.g: r.offset for r in lay.offsets(n, "g", "n").collect()}
    assert got == {i: sum(j % 3 for j in range(i)) for i in range(50)}


def test_flatten_and_pad(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 2)) AS s, array(1) AS x")
    assert lay.flatten_struct(df).columns == ["s_a", "s_b_c", "x"]
    assert df.select(lay.pad("x", 3, 0)).first()[0] == [1, 0, 0]


def test_append_rejects_other_columns(spark):
    a, b = spark.range(2), spark.range(2).withColumn("v", F.lit(1))
    with pytest.raises(ValueError):
        lay.append(a, b, "id")


def test_decayed_mean_over_a_long_series(spark):
    n, alpha = 700, 0.3
    df = spark.range(n).select(F.lit(0).alias("g"), F.col("id"), F.sin("id").alias("v"))
    got = [r.ema for r in wn.decayed_mean(df, ["g"], ["id"], "v", alpha).orderBy("id").collect()]
    s = w = 0.0
    for i in range(n):
        s, w = s * (1 - alpha) + math.sin(i), w * (1 - alpha) + 1
        assert got[i] == pytest.approx(s / w, abs=1e-9)


def test_last_of_runs_keeps_null_runs(spark):
    df = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 3, None), (0, 4, None), (0, 5, "a")], "g int, t int, v string")
    assert [r.t for r in wn.last_of_runs(df, ["g"], ["t"], "v").orderBy("t").collect()] == [2, 4, 5]


def test_checked_lookup(spark):
    rows, t = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, p int")
    assert jn.checked_lookup(rows.filter("k = 'a'"), t, ["k"]).first().p == 1
    with pytest.raises(Exception, match="no parameters"):
        jn.checked_lookup(rows, t, ["k"]).collect()


def test_principal_axes_point_to_the_farthest_atom(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 3.0, 0.1, 0.0), (0, 1.0, 0.0, 0.5)], "g int, x double, y double, z double")
    r = agg.principal_axes(df, "g").first()
    assert r.moments == sorted(r.moments)
    assert r.axes[0][0] > 0.9


def test_crystal_round_trip(spark, small):
    for r in catalog.QUERIES["crystal_build_round_trip"](spark, small).collect():
        assert r.well_defined and r.image == 0
        assert (r.fx, r.fy, r.fz) == pytest.approx((r.set_x, r.set_y, r.set_z), abs=1e-5)
        assert r.cluster_atoms >= 5


def test_trees_and_closure(spark):
    rows = cf.tree_of(5, [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert rows[0][:2] == (2, -1) and {r[0] for r in rows} == set(range(5))
    with pytest.raises(ValueError):
        cf.tree_of(3, [(0, 1)])
    atoms = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.5, 0.0, 0.0)], "mol int, atom int, x double, y double, z double")
    assert cf.closure_error(atoms, spark.createDataFrame([(0, 0, 1, 1.4)], "mol int, src int, dst int, r0 double")).first().closure_error == pytest.approx(0.1)


def test_prior_samples_follow_it(spark):
    v = spark.createDataFrame([("a", 0.15), ("a", 0.15), ("a", 0.95)], "key string, v double")
    prior = cf.fit_prior(v, 10, 0.0, 1.0, uniform=0.0)
    u = spark.createDataFrame([("a", 0.1), ("a", 0.9)], "key string, u double")
    got = sorted(r.v for r in cf.sample_prior(u, prior.filter("log_p IS NOT NULL"), 10, 0.0, 1.0).collect())
    assert 0.1 <= got[0] < 0.2 and 0.9 <= got[1] <= 1.0
    assert cf.log_prob(spark.createDataFrame([("zz", 0.5)], "key string, v double"), prior, 10, 0.0, 1.0).first().log_p == pytest.approx(0.0)


def test_optimiser_reaches_each_rows_centre(spark):
    df = spark.createDataFrame([(i, float(i), -1.0) for i in range(5)], "k int, x double, y double")
    for r in it.optimise_rows(df, "k", ["x", "y"], lambda v: ((v - np.array([2.0, 3.0])) ** 2).sum(1), tolerance=1e-12).collect():
        assert (r.x, r.y) == pytest.approx((2, 3), abs=1e-3)


def test_plugins_halve_a_batch_that_is_too_large(spark):
    def loader():
        def model(p):
            if len(p) > 3:
                raise MemoryError
            return p.assign(y=p["id"] * 2)

        return model

    hub = pg.Plugins()
    hub.add("Twice", loader)
    got = hub.apply(spark.range(20), "twice", "id long, y long").collect()
    assert sorted(r.y for r in got) == [2 * i for i in range(20)]


def test_metropolis(spark):
    from stratalith.operators.energy import metropolis

    df = spark.createDataFrame([(1.0, 0.0, 0.99), (0.0, 1.0, 0.3), (0.0, 1.0, 0.4)], "a double, b double, u double")
    assert [r[0] for r in df.select(metropolis("a", "b", 1.0, "u")).collect()] == [True, True, False]


def test_circular_difference(spark):
    assert spark.range(1).select(g.circular_difference(F.lit(0.9), F.lit(-0.9))).first()[0] == pytest.approx(-0.2)


@pytest.mark.parametrize("alone", [200_000, 0])
def test_greedy_anchors_in_rounds_and_in_one_task(spark, alone):
    """A chain of conflicts in rank order needs a round for each second point, or one task."""
    p = spark.createDataFrame([(i, i / 10) for i in range(9)], "point long, x double")
    e = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    got = sorted(r.point for r in cl.greedy_anchors(p, e, "x", "point", alone=alone).collect())
    assert got == [0, 2, 4, 6, 8]


def test_many_properties_of_an_xyz_text(spark):
    line = "\t".join(["gdb 1", *(str(float(i)) for i in range(150))])
    rows, _ = tx.read_xyz(spark.createDataFrame([("a", f"1\n{line}\nC\t0\t0\t0\t0\n1.0\nCC\tCC\nInChI")], "name string, value string"))
    assert len(rows.first().properties) == 150


def test_bonds_of_large_atoms_and_many_translations(spark):
    atoms = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 2.5), (1, 2, 5.5, 0.0, 0.0, 2.5)], "graph long, point long, x double, y double, z double, r double")
    assert jn.infer_bonds(atoms).count() == 1
    cell = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0, 0.0, 20.0, 5.0)], "k int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, radius double")
    assert jn.lattice_translations(cell, 1.0, "k").agg({"n0": "max"}).first()[0] > 20


def test_quantiles_by_scans(spark):
    """Ranks narrowed down by scans are those of one buffer, with ties and heavy tails."""
    rng = np.random.default_rng(3)
    values = [*np.exp(rng.normal(0, 4, 900)).tolist(), *([7.0] * 300), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    names = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1.0}
    assert agg.quantiles(df, "v", names, buffered=10).first() == pytest.approx(tuple(agg.quantiles(df, "v", names).first()), rel=1e-12)
