"""Queries of geometry, distance joins, energies, distributions, crystals, conformers, text sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars as m
from ..functions import tables as tb
from ..operators import aggregates as agg
from ..operators import clustering as cl
from ..operators import conformers as cf
from ..operators import crystal as cr
from ..operators import energy as en
from ..operators import iterate as it
from ..operators import joins as jn
from ..operators import plugins as pg
from ..operators import rdf as rd
from ..operators.windows import carry_forward
from ..sources import text as tx
from ..streaming import incremental as inc
from .base import ORACLE_SQL, PAIRS_SQL, POINTS_SQL, points, query, r6, table

CUT = 0.3


@query(f"WITH {PAIRS_SQL} SELECT graph, i, j, round(dist, 6) AS dist FROM e WHERE dist <= {CUT} AND i < j")
def radius_join_within_group(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return r6(jn.radius_join(p, p, CUT, group="graph").filter("i < j").select("graph", "i", "j", "dist"), "dist")


@query(f"""
WITH {PAIRS_SQL} SELECT graph, kind, count(*)::BIGINT AS n FROM (SELECT graph, CASE WHEN j % 5 <> 0 AND i % 2 = j % 2 THEN 'intra' ELSE 'inter' END AS kind FROM e WHERE dist <= {CUT} AND i % 5 <> 0) GROUP BY 1, 2
""")
def inter_intra_edges(spark, sf):
    p = points(spark, sf).withColumn("mol", F.col("point") % 2)
    return jn.radial_graph(p, CUT, molecule="mol", inside=F.col("point") % 5 != 0).groupBy("graph", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS_SQL} SELECT i, j, rank FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM e WHERE dist <= {CUT}) WHERE rank <= 3")
def k_nearest_edges(spark, sf):
    p = points(spark, sf)
    return jn.k_nearest(jn.radius_join(p, p, CUT, group="graph").filter("i <> j"), 3).select("i", "j", "rank")


@query(f"WITH {PAIRS_SQL} SELECT point, coalesce(n, 0) + 1 AS n, coalesce(n, 0) + 1 < 4 AS defect FROM p LEFT JOIN (SELECT i, count(*)::BIGINT AS n FROM e WHERE dist <= {CUT} GROUP BY i) ON i = point")
def coordination_defects(spark, sf):
    p = points(spark, sf)
    n = jn.radius_join(p, p, CUT, group="graph").groupBy(F.col("i").alias("point")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("point", "n", (F.col("n") < 4).alias("defect"))


@query(f"""
WITH {POINTS_SQL}, c AS (SELECT graph, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY graph),
d AS (SELECT p.graph, point, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS r FROM p JOIN c ON c.graph = p.graph)
SELECT graph, round(max(r), 6) AS radius, arg_max(point, r) AS farthest FROM d GROUP BY graph
""")
def group_radius(spark, sf):
    return r6(agg.radii(points(spark, sf), "graph", tie="point"), "radius")


SHIFTED = "sqrt(dx * dx + dy * dy + dz * dz)"


@query("""
WITH e AS (SELECT event_id, user_id % 20 AS g, (epoch_us(ts) // 1000000 % 86400) / 86400.0 AS t FROM events)
SELECT a.event_id AS i, b.event_id AS j, round(abs((a.t - b.t) - round_even(a.t - b.t, 0)), 9) AS gap FROM e a JOIN e b ON a.g = b.g AND a.event_id < b.event_id AND abs((a.t - b.t) - round_even(a.t - b.t, 0)) <= 0.002
""")
def periodic_wrap_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("g"), (F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(86400)) / 86400.0).alias("t"))
    width, n = 0.002, 500
    a = e.withColumn("c", F.floor(F.col("t") / width)).withColumnsRenamed({"event_id": "i", "t": "ta"}).select("g", "i", "ta", "c")
    b = e.withColumn("c0", F.floor(F.col("t") / width)).withColumn("c", F.explode(F.array(*(F.pmod(F.col("c0") + k, F.lit(n)) for k in (-1, 0, 1))))).withColumnsRenamed({"event_id": "j", "t": "tb"}).select("g", "j", "tb", "c")
    met = a.join(b, ["g", "c"]).filter("i < j").withColumn("gap", F.abs(g.minimum_image(F.col("ta") - F.col("tb")))).filter(F.col("gap") <= width)
    return r6(met.select("i", "j", "gap"), "gap", digits=9)


@query("""
SELECT x, y, z, (abs(x) + abs(y) + abs(z)) AS l1 FROM (SELECT unnest(range(-3, 4))::INT AS x), (SELECT unnest(range(-3, 4))::INT AS y), (SELECT unnest(range(-3, 4))::INT AS z) WHERE x * x + y * y + z * z <= 9
""")
def shift_grid(spark, sf):
    return jn.shift_grid(spark, 3, 3.0).select("x", "y", "z", "l1")


@query(f"""
WITH p AS (SELECT label AS graph, vec_id AS point, embedding[1]::DOUBLE * 3 AS x, embedding[2]::DOUBLE * 3 AS y, embedding[3]::DOUBLE * 3 AS z FROM embeddings),
s AS (SELECT sx, sy, sz FROM (SELECT unnest(range(-3, 4))::INT AS sx), (SELECT unnest(range(-3, 4))::INT AS sy), (SELECT unnest(range(-3, 4))::INT AS sz)),
d AS (SELECT a.graph, a.point AS i, b.point AS j, sx, sy, sz, b.x + sx * 2.0 + sy * 0.3 - a.x AS dx, b.y + sy * 2.2 + sz * 0.1 - a.y AS dy, b.z + sz * 2.4 - a.z AS dz FROM p a JOIN p b ON a.graph = b.graph, s)
SELECT graph, i, j, sx, sy, sz, round({SHIFTED}, 6) AS dist FROM d WHERE {SHIFTED} < 0.7 AND (i <> j OR sx <> 0 OR sy <> 0 OR sz <> 0)
""")
def periodic_neighbours(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("label").alias("graph"), F.col("vec_id").alias("point"), *((F.col("embedding")[i].cast("double") * 3).alias(a) for i, a in enumerate("xyz")))
    cell = {"ax": 2.0, "ay": 0.0, "az": 0.0, "bx": 0.3, "by": 2.2, "bz": 0.0, "cx": 0.0, "cy": 0.1, "cz": 2.4}
    cells = p.select("graph").distinct().select("graph", *(F.lit(v).alias(k) for k, v in cell.items()))
    return r6(jn.periodic_neighbours(p, cells, 0.7), "dist")


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS c FROM lineitem)
SELECT x.c AS i, y.c AS k, count(*)::BIGINT AS n FROM b x JOIN b y ON x.a = y.a AND x.c < y.c GROUP BY 1, 2
""")
def self_bond_angles(spark, sf):
    """Angles at each order between its suppliers: a centre has few neighbours."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    half = e.select(F.concat(F.lit("o"), "src").alias("src"), F.col("dst").cast("string").alias("dst"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a = jn.angle_paths(both, centres=F.col("centre").startswith("o"))
    i, k = F.col("i").cast("long"), F.col("k").cast("long")
    return a.select(F.least(i, k).alias("i"), F.greatest(i, k).alias("k")).groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {PAIRS_SQL}, b AS (SELECT graph, i, j FROM e WHERE dist <= 0.2)
SELECT x.graph, x.i AS i, x.j AS j, y.j AS k, z.j AS l FROM b x JOIN b y ON x.graph = y.graph AND x.j = y.i JOIN b z ON z.graph = y.graph AND y.j = z.i
WHERE y.i < y.j AND x.i <> y.j AND z.j <> x.j AND z.j <> x.i
""")
def torsion_index(spark, sf):
    p = points(spark, sf)
    b = jn.radius_join(p, p, 0.2, group="graph").filter("i <> j").select("graph", F.col("i").alias("src"), F.col("j").alias("dst"))
    return jn.torsion_paths(b, "graph").select("graph", "i", "j", "k", "l")


@query(f"""
WITH {PAIRS_SQL}, r AS (SELECT point, 0.1 + 0.01 * (point % 5) AS r FROM p)
SELECT graph, i, j FROM e JOIN r a ON a.point = i JOIN r b ON b.point = j WHERE i < j AND dist < 1.2 * (a.r + b.r)
""")
def infer_bonds(spark, sf):
    p = points(spark, sf).withColumn("r", 0.1 + 0.01 * (F.col("point") % 5))
    return jn.infer_bonds(p).select("graph", "i", "j")


ENERGY_EDGES = """s AS (SELECT graph, i, j, greatest(dist, 1e-3) AS d, 0.05 + 0.01 * (i % 3) + 0.05 + 0.01 * (j % 3) AS s, (i % 7 - 3)::DOUBLE AS q1, (j % 7 - 3)::DOUBLE AS q2 FROM e WHERE dist <= 0.3 AND i < j)"""


def energy_edges(spark, sf):
    p = points(spark, sf)
    e = jn.radius_join(p, p, 0.3, group="graph").filter("i < j")
    return p, e.withColumn("s", 0.05 + 0.01 * (F.col("i") % 3) + 0.05 + 0.01 * (F.col("j") % 3)).withColumn("q1", (F.col("i") % 7 - 3).cast("double")).withColumn("q2", (F.col("j") % 7 - 3).cast("double"))


@query(f"WITH {PAIRS_SQL}, {ENERGY_EDGES}, u AS (SELECT graph, sum(4 * (pow(s / d, 12) - pow(s / d, 6))) AS lj FROM s GROUP BY graph) SELECT g.graph, round(coalesce(lj, 0), 6) AS lj FROM (SELECT DISTINCT graph FROM p) g LEFT JOIN u ON u.graph = g.graph")
def lj_energy(spark, sf):
    p, e = energy_edges(spark, sf)
    return r6(en.energies(e, p, "graph", ["LJ"]), "lj")


@query(f"""
WITH {PAIRS_SQL}, {ENERGY_EDGES}, l AS (SELECT *, 4 * (pow(s / d, 12) - pow(s / d, 6)) AS lj FROM s)
SELECT graph, round(sum(CASE WHEN d < s THEN 24 * ((d - s) * (d - s) / (s * s) - (d - s) / s) ELSE lj END), 6) AS qlj, round(sum(CASE WHEN d < s THEN 24 / 2.5 * (exp(-2.5 / s * (d - s)) - 1) ELSE lj END), 6) AS elj,
 round(sum(q1 * q2 / d * exp(-0.92 * d)), 6) AS coulomb, round(sum(-3.2619 * exp(-d / s) + 0.2 / pow(d / s, 6)), 6) AS buckingham,
 round(sum((-4 * (d - s)) / (1 + exp(4 * (d - s))) / 0.28), 6) AS silu, round(sum(greatest(s - d, 0)), 6) AS vdw, round(max(greatest(s - d, 0)), 6) AS max_overlap FROM l GROUP BY graph
""")
def all_energies(spark, sf):
    p, e = energy_edges(spark, sf)
    names = ["qlj", "elj", "coulomb", "buckingham", "silu", "vdw", "max_overlap"]
    return r6(en.energies(e, e, "graph", names), *names)


@query(f"WITH {PAIRS_SQL} SELECT g.graph, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT graph FROM p) g LEFT JOIN (SELECT graph, count(*) AS n FROM e WHERE dist < 0.25 AND i % 2 = 0 AND j % 3 = 0 GROUP BY 1) h ON h.graph = g.graph")
def hydrogen_bonds(spark, sf):
    p = points(spark, sf)
    e = jn.radius_join(p, p, 0.25, group="graph").filter("i <> j").withColumn("donor", F.col("i") % 2 == 0).withColumn("acceptor", F.col("j") % 3 == 0)
    return en.hydrogen_bonds(e, p, "graph", 0.25)


@query(f"""
WITH {PAIRS_SQL}, h AS (SELECT graph, CASE WHEN (i + j) % 2 = 0 THEN 'same' ELSE 'cross' END AS channel, floor(dist / 0.1)::INT AS bin, count(*) AS n FROM e WHERE dist < 2 GROUP BY 1, 2, 3)
SELECT graph, channel, bin, round(n / (4.0 / 3 * pi() * (pow((bin + 1) * 0.1, 3) - pow(bin * 0.1, 3))) * CASE WHEN bin * 0.1 + 0.1 > 2.0 THEN 0 ELSE 0.5 * (1 + cos(pi() * greatest(0, least(1, bin * 0.1 + 0.1 - 1)))) END, 4) AS value FROM h
""")
def crystal_rdf(spark, sf):
    p = points(spark, sf)
    e = jn.radius_join(p, p, 2.0, group="graph", strict=True).filter("i <> j").withColumn("kind", F.when((F.col("i") + F.col("j")) % 2 == 0, "same").otherwise("cross"))
    return r6(rd.rdf(e, "graph", 2.0, 20, channel="kind").select("graph", "channel", "bin", "value"), "value", digits=4)


def event_histogram(spark, sf):
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    return e.groupBy(F.col("event_type").alias("g"), F.least(F.greatest(F.floor(F.col("value") / 5), F.lit(0)), F.lit(39)).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("""
WITH h AS (SELECT event_type AS g, least(greatest(floor(value / 5), 0), 39)::INT AS bin, count(*)::DOUBLE AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT g, b FROM (SELECT DISTINCT g FROM h), (SELECT unnest(range(0, 40))::INT AS b)),
d AS (SELECT k.g, b, coalesce(n, 0) AS n FROM k LEFT JOIN h ON h.g = k.g AND h.bin = b),
c AS (SELECT g, b, sum(n) OVER (PARTITION BY g ORDER BY b ROWS UNBOUNDED PRECEDING) / (sum(n) OVER (PARTITION BY g) + 1e-10) AS c FROM d)
SELECT x.g AS a, y.g AS b, round(sum(abs(x.c - y.c)) * 5.0, 6) AS emd FROM c x JOIN c y ON x.b = y.b AND x.g < y.g GROUP BY 1, 2
""")
def emd_between_groups(spark, sf):
    return r6(rd.emd_pairs(event_histogram(spark, sf), "g", 40, width=5.0), "emd")


@query("""
WITH r AS (SELECT o_orderpriority AS k, o_orderstatus AS channel, least(floor(o_totalprice / 25000), 29)::INT AS bin, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2, 3),
kc AS (SELECT DISTINCT k, channel FROM r), grid AS (SELECT k, channel, b FROM kc, (SELECT unnest(range(0, 30))::INT AS b)),
d AS (SELECT grid.k, grid.channel, b, coalesce(n, 0) AS n FROM grid LEFT JOIN r ON r.k = grid.k AND r.channel = grid.channel AND r.bin = b),
c AS (SELECT k, channel, b, sum(n) OVER (PARTITION BY k, channel ORDER BY b ROWS UNBOUNDED PRECEDING) / (sum(n) OVER (PARTITION BY k, channel) + 1e-10) AS c FROM d),
p AS (SELECT x.k AS a, y.k AS b, x.channel, sum(abs(x.c - y.c)) * 2.5 AS emd FROM c x JOIN c y ON x.channel = y.channel AND x.b = y.b AND x.k < y.k GROUP BY 1, 2, 3)
SELECT a, b, round(avg(emd), 6) AS distance FROM p GROUP BY 1, 2
""")
def rdf_distance(spark, sf):
    o = table(spark, sf, "orders")
    v = o.groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("channel"), F.least(F.floor(F.col("o_totalprice") / 25000), F.lit(29)).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    k = o.select(F.col("o_orderpriority").alias("k")).distinct()
    pairs = k.withColumnRenamed("k", "a").crossJoin(F.broadcast(k.withColumnRenamed("k", "b"))).filter("a < b")
    return r6(rd.rdf_distance(v, "k", 30, 2.5, pairs), "distance")


@query("""
SELECT l_orderkey, l_linenumber, round(sign(x) * ln(1 + abs(x)), 6) AS signed_log, round(CASE WHEN x > 0.5 THEN 0.5 + ln(1 + x - 0.5) ELSE x END, 6) AS rescaled, round(ln(1 + exp(10 * (x - 0.01))) / 10 + 0.01, 6) AS softplus,
 round(CASE WHEN x > 0 THEN ln(1 + x) ELSE x END, 6) AS scaled, round(2 + 3 / (1 + exp(-x)), 6) AS sigmoid, round(tanh((x - 1) / 2) * 2 + 1, 6) AS bounded,
 round(CASE WHEN x > 2 THEN 0 ELSE 0.5 * (1 + cos(pi() * greatest(0, least(1, x - 1)))) END, 6) AS cutoff, round(pow(greatest(x - 1.8, 0), 2) + pow(greatest(0.2 - x, 0), 2), 6) AS penalty
FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 20) / 15 AS x FROM lineitem)
""")
def score_rescale(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("x", (F.col("l_quantity") - 20) / 15)
    cols = {
        "signed_log": m.signed_log("x"), "rescaled": m.log_rescale_positive("x", 0.5), "softplus": m.softplus_shift("x"), "scaled": m.scale_repulsion("x"),
        "sigmoid": m.sigmoid_shift("x", 2.0, 5.0), "bounded": m.enforce_bound("x", 1.0, 2.0), "cutoff": m.smooth_cutoff("x", 2.0, 1.0), "penalty": m.bounding_penalty("x", 0.0, 2.0, 0.2),
    }
    return r6(df.withColumns(cols).select("l_orderkey", "l_linenumber", *cols), *cols)


@query("""
WITH v AS (SELECT p_partkey, p_size, p_retailprice AS x, stddev_pop(p_retailprice) OVER (PARTITION BY p_size) AS s, avg(p_retailprice) OVER (PARTITION BY p_size) AS a, min(p_retailprice) OVER (PARTITION BY p_size) AS lo, max(p_retailprice) OVER (PARTITION BY p_size) AS hi FROM part),
e AS (SELECT *, exp((x - hi) / 100) AS z FROM v)
SELECT p_partkey, round((x - a) / CASE WHEN s = 0 THEN 0.01 ELSE s END, 6) AS standardized, round((x - lo) / nullif(hi - lo, 0), 6) AS normalized, round(z / (sum(z) OVER (PARTITION BY p_size) + 1e-16), 6) AS share FROM e
""")
def window_rescale(spark, sf):
    w = Window.partitionBy("p_size")
    cols = {"standardized": m.standardize("p_retailprice", w), "normalized": m.normalize("p_retailprice", w), "share": m.softmax("p_retailprice", w, 100.0)}
    return r6(table(spark, sf, "part").withColumns(cols).select("p_partkey", *cols), *cols)


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 25 AS a, l_tax * 10 + 0.1 AS b, l_discount * 10 AS c FROM lineitem), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS t FROM t)
SELECT l_orderkey, l_linenumber, round(1 + 2 * cos(t), 6) AS trace, 1.0::DOUBLE AS det, round(cos(t) + (1 - cos(t)) * a * a / (t * t), 6) AS r11, round((1 - cos(t)) * a * b / (t * t) - sin(t) * c / t, 6) AS r12 FROM n
""")
def rotations(spark, sf):
    mat = g.rotation_matrix((F.col("l_quantity") / 25, F.col("l_tax") * 10 + 0.1, F.col("l_discount") * 10))
    cols = {"trace": g.trace(mat), "det": g.determinant(mat), "r11": mat[0][0], "r12": mat[0][1]}
    return r6(table(spark, sf, "lineitem").withColumns(cols).select("l_orderkey", "l_linenumber", *cols), *cols).withColumn("r12", F.col("r12") + 0.0)


CELL_SQL = "c AS (SELECT p_partkey, 3 + p_size % 7 AS a, 4 + p_size % 5 AS b, 5 + p_size % 3 AS c, 1.4 + 0.01 * (p_partkey % 20) AS al, 1.45 + 0.01 * (p_partkey % 15) AS be, 1.5 + 0.01 * (p_partkey % 10) AS ga, p_retailprice AS price FROM part)"


def cells(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", (3.0 + s % 7).alias("a"), (4.0 + s % 5).alias("b"), (5.0 + s % 3).alias("c"), (1.4 + 0.01 * (k % 20)).alias("alpha"), (1.45 + 0.01 * (k % 15)).alias("beta"), (1.5 + 0.01 * (k % 10)).alias("gamma"), (s % 230 + 1).cast("int").alias("sg_ind"), F.lit(2).alias("sym_mult"), (F.col("p_retailprice") / 100).alias("mol_volume"), F.col("p_retailprice").alias("mass"))


@query(f"""
WITH {CELL_SQL}, v AS (SELECT *, a * b * c * sqrt(abs(1 - cos(al) * cos(al) - cos(be) * cos(be) - cos(ga) * cos(ga) + 2 * cos(al) * cos(be) * cos(ga))) AS v FROM c)
SELECT p_partkey, round(v, 6) AS volume, round(price / 100 * 2 / v, 6) AS packing, round(price * 2 / v * 1.66054, 6) AS density, round(b * cos(ga), 6) AS f2c_01, round(c * (cos(al) - cos(be) * cos(ga)) / sin(ga), 6) AS f2c_12, 1.0::DOUBLE AS unit FROM v
""")
def cell_volume(spark, sf):
    c = cr.with_cell(cells(spark, sf))
    f2c, c2f = cr.matrix("f2c"), cr.matrix("c2f")
    unit = g.matvec(c2f, g.matvec(f2c, (F.lit(1.0), F.lit(0.25), F.lit(0.5))))[0]
    return r6(c.withColumn("unit", unit).select("p_partkey", "volume", "packing", "density", "f2c_01", "f2c_12", "unit"), "volume", "packing", "density", "f2c_01", "f2c_12", "unit")


@query(f"""
WITH {CELL_SQL}, s AS (SELECT c.*, CASE WHEN p_partkey % 230 + 1 <= 2 THEN 'triclinic' WHEN p_partkey % 230 + 1 <= 15 THEN 'monoclinic' WHEN p_partkey % 230 + 1 <= 74 THEN 'orthorhombic' WHEN p_partkey % 230 + 1 <= 142 THEN 'tetragonal'
 WHEN p_partkey % 230 + 1 <= 167 THEN 'trigonal' WHEN p_partkey % 230 + 1 <= 194 THEN 'hexagonal' ELSE 'cubic' END AS system FROM c)
SELECT p_partkey, system, round(CASE WHEN system IN ('tetragonal', 'trigonal', 'hexagonal') THEN (a + b) / 2.0 WHEN system = 'cubic' THEN (a + b + c) / 3.0 ELSE a END, 6) AS a,
 round(CASE WHEN system = 'triclinic' THEN ga WHEN system IN ('trigonal', 'hexagonal') THEN 2 * pi() / 3 ELSE pi() / 2 END, 6) AS gamma, round(CASE WHEN system IN ('triclinic', 'monoclinic') THEN be ELSE pi() / 2 END, 6) AS beta FROM s
""")
def lattice_case(spark, sf):
    c = cells(spark, sf).withColumn("sg_ind", (F.col("p_partkey") % 230 + 1).cast("int")).withColumn("system", tb.crystal_system("sg_ind"))
    e = g.enforce_system("system", *cr.CELL)
    return r6(c.select("p_partkey", "system", e["a"].alias("a"), e["gamma"].alias("gamma"), e["beta"].alias("beta")), "a", "gamma", "beta")


@query(f"""
WITH {CELL_SQL}, o AS (SELECT *, a * b * cos(ga) + a * c * cos(be) + b * c * cos(al) AS n FROM c)
SELECT p_partkey, round(n, 6) AS overlap, round(CASE WHEN n < 0 THEN pi() - al ELSE al END, 6) AS mirrored FROM o
""")
def niggli_overlap(spark, sf):
    return r6(cells(spark, sf).select("p_partkey", g.niggli_overlap(*cr.CELL).alias("overlap"), g.niggli_mirror(*cr.CELL)[0].alias("mirrored")), "overlap", "mirrored")


LATENT_SQL = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow((a.z - b.z + 1) - 2 * floor((a.z - b.z + 1) / 2) - 1, 2))"


@query(f"""
WITH {POINTS_SQL} SELECT a.point AS i, b.point AS j, round({LATENT_SQL}, 6) AS dist FROM p a JOIN p b ON a.graph = b.graph AND a.point < b.point WHERE {LATENT_SQL} < 0.15
""")
def latent_distances(spark, sf):
    """Pairs of a graph in reach: met by a radius join on the two plain axes, then the wrapped one counts."""
    p = points(spark, sf)
    near = jn.radius_join(p.withColumn("z", F.lit(0.0)), p.withColumn("z", F.lit(0.0)), 0.15, group="graph").filter("i < j").select("graph", "i", "j")
    for s, v in (("i", "v"), ("j", "w")):
        near = near.join(p.select("graph", F.col("point").alias(s), F.array("x", "y", "z").alias(v)), ["graph", s])
    return r6(near.select("i", "j", g.latent_distance(F.col("v"), F.col("w"), 2).alias("dist")).filter("dist < 0.15"), "dist")


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, l_tax * 100 - 4 AS y, l_discount * 100 - 5 AS z FROM lineitem), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM v)
SELECT l_orderkey, l_linenumber, round(r, 6) AS r, round(acos(CASE WHEN r > 0 THEN z / r ELSE 1 END), 6) AS theta, round(atan2(y, x), 6) AS phi, round(CASE WHEN z < 0 THEN -z * (2 * pi() - r) / r ELSE z END, 6) AS canonical_z FROM n
""")
def spherical_coordinates(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("x"), (F.col("l_tax") * 100 - 4).alias("y"), (F.col("l_discount") * 100 - 5).alias("z"))
    theta, phi, r = g.to_spherical(g.vec("x", "y", "z"))
    return r6(df.select("l_orderkey", "l_linenumber", r.alias("r"), theta.alias("theta"), phi.alias("phi"), g.canonical_rotvec(g.vec("x", "y", "z"))[2].alias("canonical_z")), "r", "theta", "phi", "canonical_z")


@query(f"""
WITH {POINTS_SQL}, q AS (SELECT graph, point, x, y, z, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(x, 2) OVER w AS x3, lead(y, 2) OVER w AS y3, lead(z, 2) OVER w AS z3 FROM p WINDOW w AS (PARTITION BY graph ORDER BY point)),
d AS (SELECT *, x - x2 AS ux, y - y2 AS uy, z - z2 AS uz, x3 - x2 AS vx, y3 - y2 AS vy, z3 - z2 AS vz FROM q WHERE x3 IS NOT NULL)
SELECT point, round(sqrt(ux * ux + uy * uy + uz * uz), 6) AS length, round(acos((ux * vx + uy * vy + uz * vz) / sqrt((ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz))), 6) AS angle FROM d
""")
def internal_coordinates(spark, sf):
    w = Window.partitionBy("graph").orderBy("point")
    p = points(spark, sf)
    p = p.withColumns({f"{a}{k}": F.lead(a, k - 1).over(w) for a in "xyz" for k in (2, 3)}).filter("x3 IS NOT NULL")
    a, b, c = (g.vec(*(f"{n}{k}" for n in "xyz")) for k in ("", 2, 3))
    return r6(p.select("point", g.bond_length(a, b).alias("length"), g.bond_angle(a, b, c).alias("angle")), "length", "angle")


@query(f"""
WITH {POINTS_SQL}, c AS (SELECT graph, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY graph), d AS (SELECT p.graph, x - cx AS x, y - cy AS y, z - cz AS z FROM p JOIN c ON c.graph = p.graph)
SELECT graph, round(sum(y * y + z * z), 6) AS ixx, round(sum(x * x + z * z), 6) AS iyy, round(sum(x * x + y * y), 6) AS izz, round(-sum(x * y), 6) AS ixy, round(-sum(x * z), 6) AS ixz, round(-sum(y * z), 6) AS iyz FROM d GROUP BY graph
""")
def inertia_tensor(spark, sf):
    return r6(agg.inertia(points(spark, sf), "graph"), "ixx", "iyy", "izz", "ixy", "ixz", "iyz")


@query(f"""
WITH {POINTS_SQL}, c AS (SELECT graph, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY graph), d AS (SELECT p.graph, x - cx AS x, y - cy AS y, z - cz AS z FROM p JOIN c ON c.graph = p.graph)
SELECT graph, round(2 * sum(x * x + y * y + z * z), 6) AS total FROM d GROUP BY graph
""")
def principal_moments(spark, sf):
    out = agg.principal_axes(points(spark, sf), "graph")
    return r6(out.select("graph", F.aggregate("moments", F.lit(0.0), lambda s, v: s + v).alias("total")), "total")


@query(f"WITH {POINTS_SQL} SELECT graph, round(avg((point % 5 - 2) * x) - avg(x), 6) AS d_x, round(avg((point % 5 - 2) * y) - avg(y), 6) AS d_y, round(avg((point % 5 - 2) * z) - avg(z), 6) AS d_z FROM p GROUP BY graph")
def dipole(spark, sf):
    return r6(agg.dipole(points(spark, sf).withColumn("q", (F.col("point") % 5 - 2).cast("double")), "graph", "q"), "d_x", "d_y", "d_z")


@query(f"""
WITH {PAIRS_SQL}, r AS (SELECT point, graph, 0.1 + 0.02 * (point % 3) AS r FROM p), o AS (SELECT e.graph, a.r AS a, b.r AS b, dist AS d FROM e JOIN r a ON a.point = i JOIN r b ON b.point = j WHERE i < j AND dist <= 0.28),
l AS (SELECT graph, sum(CASE WHEN d >= a + b THEN 0 WHEN d <= abs(a - b) THEN 4.0 / 3 * pi() * pow(least(a, b), 3) ELSE pi() * pow(a + b - d, 2) * (d * d + 2 * d * (a + b) - 3 * pow(a - b, 2)) / (12 * d) END) AS o FROM o GROUP BY graph)
SELECT s.graph, round(s - 0.7272 * coalesce(o, 0), 6) AS volume FROM (SELECT graph, sum(4.0 / 3 * pi() * pow(r, 3)) AS s FROM r GROUP BY graph) s LEFT JOIN l ON l.graph = s.graph
""")
def molecule_volume(spark, sf):
    p = points(spark, sf).withColumn("r", 0.1 + 0.02 * (F.col("point") % 3))
    e = jn.radius_join(p, p, 0.28, group="graph").filter("i < j")
    for s in "ij":
        e = e.join(p.select(F.col("point").alias(s), F.col("r").alias(f"r{s}")), s)
    return r6(agg.molecule_volume(p, "graph", e), "volume")


BOXES_SQL = ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in tb.ASYM_UNITS.items())


@query(f"""
WITH s AS (SELECT unnest(range(1, 231)) AS sg), t AS (SELECT * FROM (VALUES {BOXES_SQL}) AS b(sg, ax, ay, az))
SELECT s.sg::INT AS sg, CASE WHEN s.sg < 3 THEN 'triclinic' WHEN s.sg < 16 THEN 'monoclinic' WHEN s.sg < 75 THEN 'orthorhombic' WHEN s.sg < 143 THEN 'tetragonal' WHEN s.sg < 168 THEN 'trigonal'
 WHEN s.sg < 195 THEN 'hexagonal' ELSE 'cubic' END AS system, coalesce(ax, 1)::DOUBLE AS ax, coalesce(ay, 1)::DOUBLE AS ay, coalesce(az, 1)::DOUBLE AS az FROM s LEFT JOIN t ON s.sg = t.sg
""")
def space_group_lookup(spark, sf):
    return tb.space_groups(spark).select(F.col("sg_ind").alias("sg"), "system", "ax", "ay", "az")


@query("""
WITH f AS (SELECT p_partkey, (p_size % 10) / 10.0 AS fx, (p_partkey % 7) / 7.0 AS fy, 0.25 AS fz FROM part),
o AS (SELECT p_partkey, 0 AS op, fx, fy, fz FROM f UNION ALL SELECT p_partkey, 1, -fx - floor(-fx), (fy + 0.5) - floor(fy + 0.5), (0.5 - fz) - floor(0.5 - fz) FROM f)
SELECT p_partkey, op, round(CASE WHEN fx = 1 THEN 1 ELSE fx END, 6) AS fx, round(fy, 6) AS fy, round(fz, 6) AS fz FROM o
""")
def symmetry_expansion(spark, sf):
    ops = spark.createDataFrame([(4, 0, "x,y,z"), (4, 1, "-x, y+1/2, -z+1/2")], "sg_ind int, op int, s string")
    ops = ops.select("sg_ind", "op", *(c.alias(k) for k, c in tb.parse_symmetry(F.col("s")).items()))
    f = table(spark, sf, "part").select("p_partkey", F.lit(4).alias("sg_ind"), (F.col("p_size") % 10 / 10.0).alias("fx"), (F.col("p_partkey") % 7 / 7.0).alias("fy"), F.lit(0.25).alias("fz"))
    return r6(jn.symmetry_images(f, ops).select("p_partkey", "op", "fx", "fy", "fz"), "fx", "fy", "fz")


def molecules(spark, sf):
    """(vec_id, atom, x, y, z): five atoms of each embedding."""
    atoms = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("atom"), "embedding")
    return atoms.select("vec_id", "atom", *((F.element_at("embedding", F.col("atom") * 3 + i + 1).cast("double") * 4).alias(a) for i, a in enumerate("xyz")))


def molecules_and_crystals(spark, sf):
    """A crystal for each part and each embedding, whichever are more; the fewer are used in turn."""
    ends = {}
    for name, key in (("part", "p_partkey"), ("embeddings", "vec_id")):
        low, high, n = table(spark, sf, name).agg(F.min(key), F.max(key), F.countDistinct(key)).first()
        if n and high - low + 1 != n:
            raise ValueError(f"keys of {name} have gaps")
        ends[name] = (low or 0, n)
    (p0, parts), (v0, vectors) = ends["part"], ends["embeddings"]
    n = max(parts, vectors) if parts and vectors else 0
    one = spark.range(n).select(F.col("id").alias("crystal"), (F.col("id") % max(parts, 1) + p0).alias("p_partkey"), (F.col("id") % max(vectors, 1) + v0).alias("vec_id"))
    atoms = one.select("crystal", "vec_id").join(molecules(spark, sf), "vec_id").drop("vec_id")
    c = one.select("crystal", "p_partkey").join(cells(spark, sf), "p_partkey").select("crystal", "a", "b", "c", "alpha", "beta", "gamma", F.lit(2).alias("sg_ind"))
    u = {f"f{a}": 0.1 + 0.3 * m.hashed_uniform(F.lit(a), F.col("crystal")) for a in "xyz"} | {f"o{a}": m.hashed_uniform(F.lit("o" + a), F.col("crystal")) for a in "xyz"}
    ops = spark.createDataFrame([(2, 0, "x,y,z"), (2, 1, "-x,-y,-z")], "sg_ind int, op int, s string")
    ops = ops.select("sg_ind", "op", *(e.alias(k) for k, e in tb.parse_symmetry(F.col("s")).items()))
    return atoms, c.withColumns(u), ops


@query()
def crystal_build_round_trip(spark, sf):
    """Pose, unit cell, cluster and back: the found centroid is the one that was set. No SQL; tested for equality."""
    atoms, crystals, ops = molecules_and_crystals(spark, sf)
    cell = cr.unit_cell(cr.pose(atoms, crystals), crystals, ops)
    boxes = spark.createDataFrame([(2, 0.5, 1.0, 1.0)], "sg_ind int, ax double, ay double, az double")
    back = cr.reparametrise(cell, crystals, boxes)
    near = cr.cluster(cell, crystals, 4.0).groupBy("crystal").agg(F.count(F.lit(1)).alias("cluster_atoms"))
    return r6(back.join(crystals.select("crystal", *(F.col(f"f{a}").alias(f"set_{a}") for a in "xyz")), "crystal").join(near, "crystal"), "fx", "fy", "fz", "set_x", "set_y", "set_z")


@query("""
SELECT p_partkey AS crystal, round(0.1 + p_partkey % 9 / 40.0, 4) AS fx, round(0.15 + p_partkey % 8 / 30.0, 4) AS fy, round(0.2 + p_partkey % 6 / 20.0, 4) AS fz,
 round(0.3 + p_partkey % 7 / 10.0, 4) AS ox, round(p_partkey % 11 / 20.0 - 0.2, 4) AS oy, round(0.1 + p_partkey % 5 / 8.0, 4) AS oz, (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END)::INT AS hand
FROM part WHERE EXISTS (SELECT 1 FROM embeddings)
""")
def crystal_parameters(spark, sf):
    """Crystals built from centroid, orientation and handedness give all three back. Each part takes a molecule in turn."""
    n, low = table(spark, sf, "embeddings").agg(F.count(F.lit(1)), F.min("vec_id")).first()
    part = cells(spark, sf).withColumn("crystal", F.col("p_partkey")).withColumn("sg_ind", F.lit(2))
    k = F.col("p_partkey")
    set_to = {"fx": 0.1 + k % 9 / 40.0, "fy": 0.15 + k % 8 / 30.0, "fz": 0.2 + k % 6 / 20.0, "ox": 0.3 + k % 7 / 10.0, "oy": k % 11 / 20.0 - 0.2, "oz": 0.1 + k % 5 / 8.0, "hand": F.when(k % 2 == 0, 1).otherwise(-1)}
    crystals = part.withColumns(set_to)
    one = cr.standard_form(molecules(spark, sf), "vec_id")
    atoms = crystals.select("crystal", (k % max(n, 1) + (low or 0)).alias("vec_id")).join(one, "vec_id").drop("vec_id")
    ops = spark.createDataFrame([(2, 0, "x,y,z"), (2, 1, "-x,-y,-z")], "sg_ind int, op int, s string")
    ops = ops.select("sg_ind", "op", *(e.alias(c) for c, e in tb.parse_symmetry(F.col("s")).items()))
    cell = cr.unit_cell(cr.pose(atoms, crystals), crystals, ops)
    found = cr.parameters(cell, crystals, tb.space_groups(spark))
    return r6(found.select("crystal", "fx", "fy", "fz", "ox", "oy", "oz", "hand"), "fx", "fy", "fz", "ox", "oy", "oz", digits=4)


@query()
def random_crystal_search(spark, sf):
    """Best of seeded attempts by penalty."""
    mol = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 10).alias("mol_volume"), F.lit(4).alias("sym_mult"))
    return r6(cr.best_attempt(mol, "p_partkey", lambda d: d.withColumn("score", g.reduction_penalty(F.lit("triclinic"), *cr.CELL)), 5, 3).select("p_partkey", "attempt", "score"), "score")


@query()
def greedy_anchors(spark, sf):
    """All points. The recursive SQL goes point by point, so there is none; tested by brute force."""
    return cl.spaced_anchors(points(spark, sf), 0.2, "x", "point")


@query(f"""
WITH RECURSIVE {PAIRS_SQL}, l AS (SELECT i AS a, j AS b FROM e WHERE dist <= 0.2), w AS (SELECT point AS n, point AS m FROM p UNION SELECT w.n, l.b FROM w JOIN l ON w.m = l.a)
SELECT n AS point, min(m) AS cluster FROM w GROUP BY n
""")
def single_linkage(spark, sf):
    p = points(spark, sf)
    e = jn.radius_join(p, p, 0.2, group="graph").filter("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return cl.single_linkage(p, e, "point", "x").select("point", "cluster")


@query()
def average_linkage(spark, sf):
    p = points(spark, sf)
    return cl.average_linkage_of_points(p, "point", "x", 0.2, "graph")


@query(f"""
WITH {POINTS_SQL}, k AS (SELECT * FROM p WHERE point % 10 = 0), s AS (SELECT p.point, sum(exp(-(pow(p.x - k.x, 2) + pow(p.y - k.y, 2) + pow(p.z - k.z, 2)) / 0.02)) AS s FROM p, k GROUP BY 1)
SELECT point, round(0.5 * least(s, 10), 6) AS bias, 0.5 * least(s, 10) < 0.5 AS keep FROM s
""")
def umbrella_bias(spark, sf):
    p = points(spark, sf).select("point", F.array("x", "y", "z").alias("x"))
    return r6(cl.umbrella_bias(p, p.filter("point % 10 = 0"), 0.1, 0.5, key="point"), "bias")


@query("SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS label, count(*)::BIGINT AS n FROM part GROUP BY p_brand")
def dense_labels(spark, sf):
    return cl.dense_label(table(spark, sf, "part"), "p_brand").groupBy("p_brand", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS_SQL}, f AS (SELECT point, x * 2 AS f FROM p) SELECT j AS point, round(sum(f), 6) AS f FROM e JOIN f ON f.point = i WHERE dist <= 0.3 GROUP BY j")
def message_passing(spark, sf):
    p = points(spark, sf)
    e = jn.radius_join(p, p, 0.3, group="graph").filter("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return r6(pg.message_sum(e, p.select("point", (F.col("x") * 2).alias("f")), "point", ["f"]), "f")


@query()
def gradient_descent(spark, sf):
    """Each row's optimum is its own centre."""
    p = points(spark, sf).select("point", "x", "y", "z")
    return r6(it.optimise_rows(p, "point", ["x", "y", "z"], lambda v: ((v - 1.0) ** 2).sum(1)).select("point", "x", "y", "z"), "x", "y", "z", digits=2)


@query(f"WITH {POINTS_SQL} SELECT point, round(0.5 * (pow((x - 0.1) / 0.5, 2) + pow((y + 0.2) / 0.7, 2)), 6) AS harmonic, round(-ln(0.4 * exp(-0.5 * (pow(x / 0.5, 2) + pow(y / 0.5, 2))) / (2 * pi() * 0.25) + 0.6 * exp(-0.5 * (pow(x - 1, 2) + pow(y - 1, 2))) / (2 * pi())), 6) AS mixture FROM p")
def latent_energies(spark, sf):
    p = points(spark, sf)
    return r6(p.select("point", en.harmonic(["x", "y"], [0.1, -0.2], [0.5, 0.7]).alias("harmonic"), en.mixture_energy(["x", "y"], [0.4, 0.6], [[0.0, 0.0], [1.0, 1.0]], [[0.5, 0.5], [1.0, 1.0]]).alias("mixture")), "harmonic", "mixture")


@query("""
WITH v AS (SELECT p_brand AS key, p_retailprice AS v FROM part), b AS (SELECT key, least(greatest(floor((v - 800) / 60), 0), 19)::INT AS bin, count(*) AS n FROM v GROUP BY 1, 2),
g AS (SELECT k.key, r.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT key FROM b) k CROSS JOIN (SELECT unnest(range(0, 20))::INT AS bin) r LEFT JOIN b ON b.key = k.key AND b.bin = r.bin)
SELECT key, bin, round(ln((0.85 * n / sum(n) OVER (PARTITION BY key) + 0.15 / 20) / 60), 6) AS log_p FROM g
""")
def internal_prior(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.col("p_retailprice").alias("v"))
    return r6(cf.fit_prior(v, 20, 800.0, 2000.0), "log_p")


@query()
def conformer_trees(spark, sf):
    """Spanning trees and internal coordinates of small molecules from inferred bonds."""
    atoms = molecules(spark, sf).withColumnRenamed("vec_id", "mol")
    bonds = atoms.select("mol", (F.col("atom") - 1).alias("src"), F.col("atom").alias("dst")).filter("src >= 0")
    tree = cf.spanning_trees(bonds, atoms.groupBy("mol").agg(F.count(F.lit(1)).alias("n")))
    return r6(cf.measure(atoms, tree), "length", "angle", "torsion")


@query("""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, line_no::INT AS line_no, last_value(CASE WHEN length(line) > 60 THEN line_no END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY line_no ROWS UNBOUNDED PRECEDING)::INT AS section FROM l
""")
def thermo_text_parse(spark, sf):
    c = table(spark, sf, "conversations").filter("text IS NOT NULL")
    rows = tx.numbered_lines(c.withColumn("key", F.struct("conv_id", "turn")), "key", "text")
    out = carry_forward(rows, ["key"], ["line_no"], F.when(F.length("line") > 60, F.col("line_no")), "section")
    return out.select("key.conv_id", "key.turn", "line_no", "section")


@query("""
WITH g AS (SELECT l_orderkey AS name, count(*) AS n FROM lineitem GROUP BY 1)
SELECT name, atom, 'C' AS symbol, 6 AS z, round(x, 3) AS x, q FROM (SELECT l_orderkey AS name, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_tax) - 1)::INT AS atom, l_quantity AS x, l_tax AS q FROM lineitem)
""")
def xyz_parse(spark, sf):
    """Atoms written as XYZ texts and read back; rows alike in line and part go by quantity and tax."""
    li = table(spark, sf, "lineitem")
    line = F.concat(F.lit("C\t"), F.col("l_quantity").cast("string"), F.lit("\t0\t0\t"), F.col("l_tax").cast("string"))
    t = li.groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_tax", line.alias("s")))).alias("rows"))
    t = t.select("name", F.concat(F.size("rows").cast("string"), F.lit("\ngdb 1\t2.5\n"), F.array_join(F.transform("rows", lambda r: r["s"]), "\n"), F.lit("\n1.0\nCCO\tCCO\nInChI\n")).alias("value"))
    _, atoms = tx.read_xyz(t)
    return r6(atoms.select("name", "atom", "symbol", "z", "x", "q"), "x", digits=3)


@query("""
SELECT event_type AS name, event_id AS step, round(value, 4) AS temp FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
""")
def thermo_log(spark, sf):
    """Log rows between Step and Loop lines, written and read back; each step is written twice and the last stays. A log for each type and 500 event ids, so that no text grows with the table."""
    e = table(spark, sf, "events")
    row = F.concat_ws(" ", F.col("event_id").cast("string"), F.format_string("%.4f", F.col("value")))
    rows = e.groupBy(F.concat("event_type", F.lit("#"), F.floor(F.col("event_id") / 500).cast("string")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("event_id", row.alias("s")))).alias("r"))
    twice = F.flatten(F.transform("r", lambda x: F.array(F.concat(x["event_id"].cast("string"), F.lit(" 0.0")), x["s"])))
    t = rows.select("name", F.concat(F.lit("units real\nStep Temp\n"), F.array_join(twice, "\n"), F.lit("\nLoop time of 1\n12 13\n")).alias("value"))
    return r6(tx.read_thermo(t).select(F.regexp_replace("name", "#[^#]*$", "").alias("name"), "step", F.col("values")[1].alias("temp")), "temp", digits=4)


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    """Events by type and hour. The function takes streams too; its streaming run is tested on files."""
    return inc.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "1 hour", "1 day").select("event_type", "start", "n")
