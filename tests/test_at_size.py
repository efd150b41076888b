"""What is counted, chosen or joined without a row for each pair, against brute force."""

from __future__ import annotations

import math
import random
import subprocess
import sys
from collections import Counter
from itertools import product
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalith.operators import clustering as cl
from stratalith.operators import ellipsoids as el
from stratalith.operators import joins as jn
from stratalith.plans import catalog


def no_pairs(*args, **kwargs):
    raise AssertionError("pairs are listed as rows")


def crowd(spark, n, seed, width=1.0):
    rng = random.Random(seed)
    rows = [(i % 3, i, *(rng.uniform(0, width) for _ in "xyz")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "graph long, point long, x double, y double, z double")


def test_typed_pairs_are_counted(spark, small, monkeypatch):
    rows, df = crowd(spark, 150, 1)
    kinds = {i: "CNO"[i % 7 % 3] for i in range(150)}
    want = Counter((p[0], *sorted((kinds[p[1]], kinds[q[1]])), math.floor(math.dist(p[2:], q[2:]) * 100)) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and math.dist(p[2:], q[2:]) <= 0.4)
    typed = df.withColumn("z", df["z"]).withColumn("kind", F.element_at(F.array(*map(F.lit, "CNO")), (F.col("point") % 7 % 3 + 1).cast("int")))
    met = {(r.graph, r.a, r.b, r.d): r.n for r in jn.typed_pair_counts(typed, 0.4, kind="kind").collect()}
    assert met == want
    long = {r.graph: [tuple(x) for x in r.fingerprint] for r in jn.typed_pairs(typed, 0.4, kind="kind").collect()}
    assert long == {g: sorted(k[1:] for k, n in want.items() if k[0] == g for _ in range(n)) for g in range(3)}
    monkeypatch.setattr(jn, "radius_join", no_pairs)
    assert catalog.QUERIES["typed_pair_fingerprint"](spark, small).count() > 0


@pytest.mark.parametrize("batch", [4, 1000])
def test_anchors_in_batches(spark, small, monkeypatch, batch):
    rows, df = crowd(spark, 30, 2)
    rows += [(0, 90, 0.5, None, 0.5), (0, 91, None, 0.5, 0.5), (0, 92, *rows[0][2:])]
    df = df.unionByName(spark.createDataFrame(rows[30:], df.schema))
    kept = []
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[1])):
        if None in r or all(None in k or math.dist(r[2:], k[2:]) > 0.4 for k in kept):
            kept.append(r)
    assert sorted(r.point for r in cl.spaced_anchors(df, 0.4, "x", "point", batch=batch).collect()) == sorted(k[1] for k in kept)
    monkeypatch.setattr(jn, "radius_join", no_pairs)
    assert catalog.QUERIES["greedy_anchors"](spark, small).count() > 0


def test_grid_volume_by_columns(spark):
    """Single spheres and overlapping ones, some on the grid's own points, over several slabs."""
    rng = random.Random(3)
    atoms = [(m, *(rng.uniform(-1, 1) for _ in "xyz"), rng.uniform(0, 0.6)) for m in range(9) for _ in range(1 + 5 * (m % 3))]
    atoms += [(20, 0.1, 0.1, 0.1, 0.2), (20, 0.1, 0.1, 0.3, 0.4), (21, 0.05, 0.05, 0.05, 0.01), (22, 5.0, 0.0, 0.0, None), (23, 0.0, 0.0, 0.0, 0.001)]
    df = spark.createDataFrame(atoms, "mol long, x double, y double, z double, r double")
    step, want = 0.1, {}
    for m, x, y, z, r in atoms:
        for c in product(*(range(math.floor((v - r) / step), math.floor((v + r) / step) + 1) for v in (x, y, z))) if r else ():
            if sum(((k + 0.5) * step - v) * ((k + 0.5) * step - v) for k, v in zip(c, (x, y, z), strict=True)) <= r * r:
                want.setdefault(m, set()).add(c)
    found = el.grid_volume(df, "mol", step, slab=4)
    assert {r.mol: round(r.volume / step**3) for r in found.collect()} == {m: len(c) for m, c in want.items()}
    assert "cz" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("held", [12_000, 10])
def test_average_linkage_of_points(spark, held):
    """The clusters of the operator on listed distances, also with equal distances, and no bound on points."""
    _, df = crowd(spark, 150, 4)
    df = df.withColumns({a: F.when(F.col("point") % 4 == 0, F.round(a, 1)).otherwise(F.col(a)) for a in "xyz"})
    d = jn.radius_join(df, df, 6.0, group="graph").filter("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), "dist")
    want = sorted(map(tuple, cl.average_linkage(df, d.filter("dist < 0.3"), d, "point", "x", 0.3).select("point", "cluster", "best").collect()))
    assert len({c for _, c, _ in want}) < 140
    assert sorted(map(tuple, cl.average_linkage_of_points(df, "point", "x", 0.3, "graph", held=held).select("point", "cluster", "best").collect())) == want


@pytest.mark.parametrize("width", [8192, 16])
def test_nonbonded_points(spark, small, monkeypatch, width):
    rows, df = crowd(spark, 180, 5)
    d = {(p[1], q[1]): math.dist(p[2:], q[2:]) for p in rows for q in rows if p[0] == q[0] and p[1] != q[1]}
    near = {(i, j) for (i, j), x in d.items() if x <= 0.25}
    want = sorted((i % 3, i, j) for (i, j), x in d.items() if i < j and x <= 0.45 and (i, j) not in near and not any((i, k) in near and (k, j) in near for k in range(i % 3, 180, 3)))
    assert want
    assert sorted(map(tuple, jn.nonbonded_points(df, 0.45, 0.25, width=width).collect())) == want
    monkeypatch.setattr(jn, "radius_join", no_pairs)
    catalog.QUERIES["nonbonded_pairs"](spark, small).count()


@pytest.mark.parametrize("share", [256, 2])
def test_torsions_from_lists_of_neighbours(spark, share):
    """Rings, chains, hubs, ends without another neighbour and a bond listed twice, of each group alone."""
    half = [(g, *b) for g in (1, 2) for b in [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (10, 11), (12, 13), (13, 14), (20 + g, 30), (20 + g, 30)] + [(30, 31 + k) for k in range(7)] + [(40, 20 + g), (40, 5)]]
    half += [(3, 50, 51 + k) for k in range(9)] + [(4, 60, 61), (4, 61, 62), (4, 60, 62)]
    both = [(g, *p) for g, a, b in half for p in ((a, b), (b, a))]
    want = sorted((g, i, j, k, m) for g, i, j in both for h, j2, k in both if (g, j) == (h, j2) and j < k and i != k for h, k2, m in both if (g, k) == (h, k2) and m not in (i, j))
    df = spark.createDataFrame(both, "graph long, src long, dst long")
    assert want and sorted(map(tuple, jn.torsion_paths(df, "graph", share=share).collect())) == want
    one = df.filter("graph = 1").drop("graph")
    assert sorted(map(tuple, jn.torsion_paths(one, share=share).collect())) == [p[1:] for p in want if p[0] == 1]
    assert jn.torsion_paths(df.filter("graph > 2"), "graph").count() == 0


def test_torsions_are_made_in_many_tasks(spark):
    """Few bonds have many paths, also those of one bond between two hubs: no task makes more than its part."""
    crowded = [(0, i, j) for i in range(40) for j in range(40) if i != j]
    hubs = [(1, *p) for h in (0, 1) for k in range(2, 1002) for p in ((h, 2 * k + h), (2 * k + h, h))] + [(1, 0, 1), (1, 1, 0)]
    for rows, n, more in ((crowded, 40 * 39 * 38 * 37 // 2, {}), (hubs, 1000 * 1000, {"share": 32})):
        made = jn.torsion_paths(spark.createDataFrame(rows, "graph long, src long, dst long"), "graph", **more)
        parts = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(parts) == n and len(parts) == 4 and max(parts) < n / 2


@pytest.mark.parametrize(("share", "wide", "tile"), [(5, 3, (2, 2)), (2, 4, (1, 3)), (256, 65536, (3, 1))])
def test_torsions_in_pieces_of_both_ends(spark, share, wide, tile):
    """Any sizes of pieces and tiles give each path once."""
    rng = random.Random(6)
    half = {(g, *sorted(rng.sample(range(14), 2))) for g in (1, 2) for _ in range(40)} | {(3, h, 100 * (h + 1) + k) for h in (0, 1) for k in range(11)} | {(3, 0, 1)}
    both = [(g, *p) for g, a, b in half for p in ((a, b), (b, a))]
    want = sorted((g, i, j, k, m) for g, i, j in both for h, j2, k in both if (g, j) == (h, j2) and j < k and i != k for h2, k2, m in both if (g, k) == (h2, k2) and m not in (i, j))
    assert sum(w[0] == 3 for w in want) == 121
    made = jn.torsion_paths(spark.createDataFrame(both, "graph long, src long, dst long"), "graph", share=share, wide=wide, tile=tile)
    assert sorted(map(tuple, made.collect())) == want


def test_torsions_of_hubs_are_not_held(tmp_path):
    """15 million paths of one bond go through a heap of 1 GB, which can't hold them as rows."""
    code = f"""
from pyspark.sql import SparkSession
from stratalith.operators import joins as jn
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
half = spark.range(256).selectExpr("0L AS a", "id + 2 AS b").union(spark.range(60000).selectExpr("1L AS a", "id + 1000000 AS b")).union(spark.sql("SELECT 0L, 1L"))
made = jn.torsion_paths(half.union(half.select("b", "a")).toDF("src", "dst"))
made.write.format("noop").mode("overwrite").save()
print("made", made.count())
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert run.stdout.split() == ["made", str(256 * 60000)], run.stderr[-2000:]
