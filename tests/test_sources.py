"""Text formats, sinks and streams."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stratalith.sources import text as tx
from stratalith.streaming import incremental as inc

DUMP = """ITEM: TIMESTEP
100
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
0 10
0 11
0 12
ITEM: ATOMS id mol element xu yu zu
1 1 C 0.5 1.5 2.5
2 1 H 0.1 0.2 0.3
ITEM: TIMESTEP
200
ITEM: NUMBER OF ATOMS
1
ITEM: BOX BOUNDS xy xz yz
0 10 1
0 11 0
0 12 0
ITEM: ATOMS id mol element xu yu zu
1 1 C 9.5 8.5 7.5
"""


def texts(spark, **t):
    return spark.createDataFrame(list(t.items()), "name string, value string")


def test_xyz(spark):
    good = "2\ngdb 1\t1.5\t2.5\nC\t0.0\t1.0*^-2\t2.0\t-0.1\nH\t1.0\t0.0\t0.0\t0.1\n100.0\t200.0\nCC\tCC\nInChI\n"
    mol, atoms = tx.read_xyz(texts(spark, a=good, b="not a number\n"))
    m = mol.collect()
    assert len(m) == 1 and m[0].n_atoms == 2 and m[0].properties == [1.5, 2.5] and m[0].smiles == "CC"
    rows = atoms.orderBy("atom").collect()
    assert [(r.z, r.q) for r in rows] == [(6, -0.1), (1, 0.1)] and rows[0].y == pytest.approx(0.01)


def test_dump(spark):
    rows = tx.read_dump(texts(spark, run=DUMP)).orderBy("timestep", "id").collect()
    assert [(r.timestep, r.row, r.id, r.element, r.x) for r in rows] == [(100, 0, 1, "C", 0.5), (100, 1, 2, "H", 0.1), (200, 0, 1, "C", 9.5)]
    box = {r.timestep: r.bounds for r in tx.dump_boxes(texts(spark, run=DUMP)).collect()}
    assert box[100][2] == [0.0, 12.0] and box[200][0] == [0.0, 10.0, 1.0]


def test_thermo(spark):
    log = "banner\nStep Temp E\n0 300 1.0\n10 310 2.0\n10 311 2.5\nLoop time\nStep Temp E\n0 1 1\nLoop\n"
    rows = tx.read_thermo(texts(spark, a=log)).orderBy("block", "step").collect()
    assert [(r.block, r.step, r["values"][1]) for r in rows] == [(1, 0, 300.0), (1, 10, 311.0), (2, 0, 1.0)]


def test_frames(spark):
    got = tx.read_frames(texts(spark, a="1 2\n1 300 5 7\n2 400 7 9\n2 1\n1 100 1 1\n")).orderBy("frame").collect()
    assert [(r.frame, r.temp, r.internal) for r in got] == [(1, 350.0, 8.0), (2, 100.0, 1.0)]


def test_cif_round_trip(spark):
    c = spark.createDataFrame([("q", 5.0, 6.0, 7.0, 1.5, 1.6, 1.7, 14)], "name string, a double, b double, c double, alpha double, beta double, gamma double, sg_ind int")
    back = tx.read_cif(tx.cif_text(c, "name")).first()
    assert (back.a, back.gamma, back.sg_ind) == pytest.approx((5.0, 1.7, 14), abs=1e-6)
    ops = tx.read_cif(texts(spark, a="loop_\n_symmetry_equiv_pos_as_xyz\n'x,y,z'\n2 '-x, y+1/2, -z'\n")).first()
    assert ops.operators == ["x,y,z", "-x, y+1/2, -z"] and ops.a is None


def test_xyz_text(spark):
    a = spark.createDataFrame([("m", 1, "H", 0.0, 0.0, 1.0), ("m", 0, "O", 0.0, 0.0, 0.0)], "name string, atom int, symbol string, x double, y double, z double")
    assert tx.xyz_text(a, "name").first().value == "2\nm\nO 0.000000 0.000000 0.000000\nH 0.000000 0.000000 1.000000\n"


def test_chunks_and_resume(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "c"))
    assert tx.load_chunks(spark, str(tmp_path / "c"), 5, "id").count() == 20
    assert tx.unseen(spark.range(5), spark.range(3), "id").count() == 2
    f = spark.createDataFrame([("a", 0), ("b", 5), ("c", 5)], "path string, size int")
    assert tx.sample_lines(f, 5, 1).count() == 2


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for _ in range(2):
        spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 1000).alias("ts"), F.lit("a").alias("k")).coalesce(1).write.mode("append").parquet(src)
        schema = "id long, ts timestamp, k string"
        inc.append_log(inc.polled(spark, src, schema), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 20
    q = inc.buffered(inc.polled(spark, src, schema, 1), str(tmp_path / "buf"), str(tmp_path / "ck2"), "id", 15)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "buf" / "version=1")).count() == 15
    win = inc.windowed_counts(inc.polled(spark, src, schema), "ts", "k", "1 hour", "1 minute")
    q = win.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == 20
    assert math.isfinite(spark.sql("SELECT count(*) FROM win").first()[0])
