"""Queries of training and search records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import training as tr
from .base import PAIRS_SQL, POINTS_SQL, points, query, r6, table


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount * 10 - l_tax * 10) / ln(10), 6) AS score, round((l_discount * 10 - l_tax * 10) / ln(10) / l_quantity, 6) AS by_size FROM lineitem
""")
def class_scores(spark, sf):
    score = tr.class_score(F.col("l_tax") * 10, F.col("l_discount") * 10)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"), tr.score_by_size(score, "l_quantity").alias("by_size"))
    return r6(rows, "score", "by_size")


@query(f"""
WITH {PAIRS_SQL}, r AS (SELECT DISTINCT graph, 0.08 + 0.01 * (graph % 3) AS r FROM p)
SELECT r.graph, round(coalesce(sum(greatest(0, 2 - dist / r)), 0), 6) AS loss FROM r LEFT JOIN e ON e.graph = r.graph AND dist <= 0.2 GROUP BY r.graph
""")
def overlap_loss(spark, sf):
    return r6(tr.overlap_loss(points(spark, sf).withColumn("radius", 0.08 + 0.01 * (F.col("graph") % 3))), "loss")


@query("""
WITH l AS (SELECT event_type, event_id, value AS test, value / (1 + event_id % 3) AS train FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 60),
h AS (SELECT event_type, quantile_cont(test, 0.95) AS q, avg(test / train) AS ratio FROM l GROUP BY 1),
s AS (SELECT event_type, regr_slope(log10(test), i) AS slope FROM (SELECT l.event_type, test, row_number() OVER (PARTITION BY l.event_type ORDER BY event_id) - 1 AS i FROM l JOIN h ON l.event_type = h.event_type WHERE test < q) GROUP BY 1)
SELECT h.event_type, round(slope, 6) AS slope, round(ratio, 6) AS ratio, slope > -0.001 OR ratio > 2.05 AS converged FROM h JOIN s ON s.event_type = h.event_type
""")
def convergence_check(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", F.col("value").alias("test"), (F.col("value") / (1 + F.col("event_id") % 3)).alias("train"))
    return r6(tr.convergence(e, ["event_type"], "event_id", 60, 0.001, 2.05, train="train"), "slope", "ratio")


@query("SELECT user_id, event_type AS phase, round(max(value) - min(value), 6) AS time FROM events GROUP BY 1, 2")
def phase_times(spark, sf):
    """Start and end marks of each user's phases, put on in one table and met again."""
    ends = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    marks = ends.select("user_id", F.explode(F.array(*(F.struct(F.concat("event_type", F.lit(s)).alias("name"), F.col(c).alias("value")) for s, c in (("_start", "low"), ("_end", "high"))))).alias("m")).select("user_id", "m.*")
    return r6(tr.phase_times(marks, ["user_id"]), "time")


@query("""
SELECT 'few' AS of, l_tax::DOUBLE AS low, l_tax::DOUBLE AS high, count(*)::BIGINT AS n FROM lineitem GROUP BY l_tax UNION ALL
SELECT 'many', round(b * w + lo, 6), round((b + 1) * w + lo, 6), count(*)::BIGINT FROM (SELECT least(floor((o_totalprice - lo) / w), 19) AS b, w, lo FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders)) GROUP BY b, w, lo
""")
def adaptive_histogram(spark, sf):
    both = (("few", tr.adaptive_histogram(table(spark, sf, "lineitem"), "l_tax", 20)), ("many", tr.adaptive_histogram(table(spark, sf, "orders"), "o_totalprice", 20)))
    rows = [df.select(F.lit(name).alias("of"), "low", "high", "n") for name, df in both]
    return r6(rows[0].unionByName(rows[1]), "low", "high")


@query(f"""
WITH {POINTS_SQL}, c AS (SELECT graph, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1)
SELECT p.graph, point, (row_number() OVER (PARTITION BY p.graph ORDER BY point % 3, round(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2), 9) DESC, point) - 1)::INT AS place FROM p JOIN c ON p.graph = c.graph
""")
def canonical_order(spark, sf):
    return tr.canonical_order(points(spark, sf).withColumn("kind", F.col("point") % 3), "graph", "kind", tie="point").select("graph", "point", "place")


@query(f"WITH {POINTS_SQL}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p) SELECT point FROM p, c WHERE pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2) < 0.09")
def within_cluster(spark, sf):
    return tr.within_cluster(points(spark, sf), 0.3).select("point")


@query(f"WITH {PAIRS_SQL} SELECT i AS src, j AS dst, round(dist, 6) AS dist FROM e WHERE dist < 0.15")
def distance_graph(spark, sf):
    p = points(spark, sf)
    pairs = jn.radius_join(p, p, 0.2, group="graph").filter("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), "dist")
    return r6(tr.neighbours_by_distance(pairs, 0.15), "dist")
