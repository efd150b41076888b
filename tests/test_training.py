"""Records and settings."""

from __future__ import annotations

from types import SimpleNamespace

from stratalith.operators import training as tr


def test_settings():
    main, base, full = {"a": 1, "n": {"x": 1}}, {"a": 2, "n": {"x": 2, "y": 3}}, {"b": 4, "n": {"z": 5}}
    assert tr.merged(main, base, full) == {"a": 1, "b": 4, "n": {"x": 1, "y": 3, "z": 5}}
    assert main == {"a": 1, "n": {"x": 1}}
    assert tr.as_dict(SimpleNamespace(a=1, n=SimpleNamespace(x=[2]))) == {"a": 1, "n": {"x": [2]}}


def test_convergence_of_odd_records(spark):
    rows = [("nan", i, float("nan") if i == 3 else 10.0 ** -i, 1.0) for i in range(8)] + [("falls", i, 10.0 ** -i, 10.0 ** -i) for i in range(8)]
    rows += [("flat", i, 1.0, 1.0) for i in range(8)] + [("over", i, 10.0 ** -i, 10.0 ** -i / 9) for i in range(8)]
    got = {r.k: r.converged for r in tr.convergence(spark.createDataFrame(rows, "k string, i int, test double, train double"), ["k"], "i", 5, 0.001, 3.0, train="train", scrub=False).collect()}
    assert got == {"nan": True, "falls": False, "flat": True, "over": True}


def test_losses(spark):
    terms = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert sorted(r.loss for r in tr.weighted_loss(terms, {"a": 2.0, "b": 1.0}).collect()) == [2.0, 7.0]
    centres = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0), (1, 2, 1.0, 0.0, 0.0, 1.0), (2, 1, 0.0, 0.0, 0.0, 1.0)], "graph long, point long, x double, y double, z double, radius double")
    assert {r.graph: r.loss for r in tr.overlap_loss(centres).collect()} == {1: 2.0, 2: 0.0}
    assert tr.overlap_loss(centres.limit(0)).count() == 0
