"""Queries of filters, layout, aggregations, windows, top-k and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as m
from ..operators import aggregates as agg
from ..operators import clustering as cl
from ..operators import filters as fl
from ..operators import iterate as it
from ..operators import joins as jn
from ..operators import layout as lay
from ..operators import plugins as pg
from ..operators import sets as st
from ..operators import windows as wn
from .base import ORACLE_SQL, query, r6, table


@query("""
WITH f AS (SELECT *, CASE WHEN regexp_matches(c_name, '[0-9]$') THEN substr(c_name, 1, greatest(length(c_name) - 2, 0)) ELSE c_name END AS family
           FROM customer WHERE c_acctbal BETWEEN 0 AND 9000 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AND NOT c_nationkey IN (3, 4)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS r FROM f) WHERE r = 1),
q AS (SELECT quantile_cont(c_acctbal, 0.05) AS q05, quantile_cont(c_acctbal, 0.95) AS q95 FROM k)
SELECT count(*)::BIGINT AS n, round(min(c_acctbal), 6) AS lo, round(max(c_acctbal), 6) AS hi, round(avg(c_acctbal), 6) AS mean,
       round(avg(greatest(least(c_acctbal, q95), q05)), 6) AS tight_mean, round(stddev_samp(greatest(least(c_acctbal, q95), q05)), 6) AS tight_std FROM k, q
""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    rows = fl.filter_conditions(table(spark, sf, "customer"), [("c_acctbal", "range", (0.0, 9000.0)), ("c_mktsegment", "in", ["BUILDING", "AUTOMOBILE", "MACHINERY"]), ("c_nationkey", "not_in", [3, 4])])
    kept = cl.one_per_family(rows, "c_name", "c_custkey")
    s = agg.basic_stats(kept, "c_acctbal").crossJoin(kept.agg(F.count(F.lit(1)).alias("n")))
    return r6(s.select("n", "lo", "hi", "mean", "tight_mean", "tight_std"), "lo", "hi", "mean", "tight_mean", "tight_std")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus IN ('O')")
def filter_conditions(spark, sf):
    df = fl.filter_conditions(table(spark, sf, "lineitem"), [("l_quantity", "range", (10.0, 20.0)), ("l_returnflag", "in", ["A", "R"]), ("l_linestatus", "not_in", ["O"])])
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag NOT IN ('A', 'N'))")
def filter_subset(spark, sf):
    return fl.groups_within(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "l_returnflag", ["A", "N"]).select("o_orderkey", "o_orderstatus")


@query("""
SELECT CASE WHEN l_quantity < 5 THEN 'too few atoms' WHEN l_discount > 0.08 THEN 'disordered' WHEN l_returnflag = 'R' THEN 'polymeric' WHEN l_extendedprice > 80000 THEN 'too large' ELSE 'ok' END AS reason, count(*)::BIGINT AS n
FROM lineitem GROUP BY 1
""")
def filter_reasons(spark, sf):
    c = F.col
    rules = [("too few atoms", c("l_quantity") < 5), ("disordered", c("l_discount") > 0.08), ("polymeric", c("l_returnflag") == "R"), ("too large", c("l_extendedprice") > 80000)]
    return fl.reason_counts(table(spark, sf, "lineitem"), rules)


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice < (SELECT quantile_cont(p_retailprice, 0.1) FROM part)")
def quantile_slice(spark, sf):
    return fl.below_quantile(table(spark, sf, "part"), "p_retailprice", 0.1).select("p_partkey", "p_retailprice")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag <> 'N' OR NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_returnflag <> 'N')
""")
def drop_element(spark, sf):
    return fl.drop_element(table(spark, sf, "lineitem").withColumn("z", F.when(F.col("l_returnflag") == "N", 1).otherwise(6)), "l_orderkey", "z", 1).select("l_orderkey", "l_linenumber")


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem)
SELECT src, dst FROM b WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND dst IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""")
def induced_subgraph(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return fl.induced_subgraph(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "node"), e, F.col("o_orderstatus") == "F")[1]


@query("""
WITH f AS (SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[0-9]$') THEN substr(c_name, 1, greatest(length(c_name) - 2, 0)) ELSE c_name END AS family FROM customer)
SELECT family, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS r FROM f) WHERE r = 1
""")
def identifier_family_dedup(spark, sf):
    return cl.one_per_family(table(spark, sf, "customer"), "c_name", "c_custkey").select("family", "c_custkey")


@query("SELECT md5(coalesce(text, '')) AS hash, min(doc_id) AS representative, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def exact_duplicate_dedup(spark, sf):
    return cl.exact_groups(table(spark, sf, "documents"), "text", "doc_id")


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem)
SELECT round(min(l_extendedprice), 6) AS lo, round(max(l_extendedprice), 6) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
       round(avg(greatest(least(l_extendedprice, b), a)), 4) AS tight_mean, round(stddev_samp(greatest(least(l_extendedprice, b), a)), 4) AS tight_std, round(any_value(a), 4) AS q_low, round(any_value(b), 4) AS q_high FROM lineitem, q
""")
def clipped_stats(spark, sf):
    return r6(r6(agg.basic_stats(table(spark, sf, "lineitem"), "l_extendedprice"), "lo", "hi"), "mean", "std", "tight_mean", "tight_std", "q_low", "q_high", digits=4)


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders),
s AS (SELECT avg(greatest(least(o_totalprice, b), a)) AS m, stddev_samp(greatest(least(o_totalprice, b), a)) AS s FROM orders, q)
SELECT o_orderkey, round((o_totalprice - m) / CASE WHEN s < 1e-4 THEN 1 ELSE s END, 6) AS target FROM orders, s
""")
def standardized_target(spark, sf):
    return r6(agg.standardized_target(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "target"), "target")


@query("""
WITH l AS (SELECT 'l_quantity' AS name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT name, count(v)::BIGINT AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.95), 6) AS q95 FROM l GROUP BY name
""")
def stats_by_column(spark, sf):
    return r6(agg.stats_by_column(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), "lo", "hi", "mean", "std", "q05", "q95")


@query("""
SELECT 'l_quantity' AS a, 'l_quantity' AS b, round(covar_samp(l_quantity, l_quantity), 6) AS cov FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(covar_samp(l_quantity, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', round(covar_samp(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', round(covar_samp(l_discount, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_discount', 'l_tax', round(covar_samp(l_discount, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_tax', 'l_tax', round(covar_samp(l_tax, l_tax), 6) FROM lineitem
""")
def length_covariance(spark, sf):
    return r6(agg.covariance_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), "cov")


@query("SELECT p_brand, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_brand")
def value_counts_share(spark, sf):
    return r6(agg.value_shares(table(spark, sf, "part"), "p_brand"), "share")


@query("""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS c FROM orders)
SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*)::BIGINT AS n, round(count(*) / (any_value(c) * any_value((hi - lo) / 50)), 12) AS density FROM orders, s GROUP BY 1
""")
def histogram_density(spark, sf):
    return r6(agg.density_histogram(table(spark, sf, "orders"), "o_totalprice", 50), "density", digits=12)


@query("SELECT l_returnflag, round_even(least(greatest(l_quantity, 0.0), 48.0) / 50.0 * 25, 0)::INT AS bin, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def batch_histogram(spark, sf):
    return agg.rounded_histogram(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 50.0, 25)


@query("SELECT l_returnflag, floor((l_quantity - 10.0) / 2.0)::INT AS bin, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 GROUP BY 1, 2")
def floor_histogram(spark, sf):
    return agg.floor_histogram(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 10.0, 40.0, 15)


@query("""
SELECT event_type, b AS bin, round(sum(exp(-0.5 * pow((value - b * 100.0 / 19) / 5.0, 2))) / sqrt(2 * pi()), 6) AS density
FROM events, (SELECT unnest(range(0, 20))::INT AS b) WHERE value IS NOT NULL GROUP BY 1, 2
""")
def smooth_histogram(spark, sf):
    return r6(agg.smooth_histogram(table(spark, sf, "events"), "event_type", "value", 0.0, 100.0, 20), "density")


@query("""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
h AS (SELECT o_orderpriority AS g, least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*)::DOUBLE AS n FROM orders, s WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2),
w AS (SELECT bin, sum(CASE WHEN g = '1-URGENT' THEN n ELSE 0 END) AS a, sum(CASE WHEN g = '5-LOW' THEN n ELSE 0 END) AS b FROM h GROUP BY bin)
SELECT round(sum(least(a, b)) / nullif((sum(a) + sum(b)) / 2, 0), 6) AS overlap FROM w
""")
def histogram_overlap(spark, sf):
    o = table(spark, sf, "orders")
    s = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    h = o.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).crossJoin(F.broadcast(s)).select(F.col("o_orderpriority").alias("g"), agg.bin_of("o_totalprice", F.col("lo"), (F.col("hi") - F.col("lo")) / 20, 20).alias("bin"))
    return r6(agg.histogram_overlap(h.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n")), "g", "1-URGENT", "5-LOW"), "overlap")


@query("""
WITH d AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS g FROM lineitem)
SELECT round(avg(abs(t - g)), 4) AS mae, round(avg(abs(t - g) / nullif(abs(t), 0)), 6) AS relative_mae, round(avg((t - g) * (t - g)), 2) AS mse, round(stddev_pop((t - g) * (t - g)), 2) AS mse_std, round(corr(t, g), 6) AS r, round(regr_slope(g, t), 6) AS slope FROM d
""")
def corr_and_regression(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("g"))
    return r6(r6(r6(agg.regression_metrics(d, "t", "g"), "relative_mae", "r", "slope"), "mae", digits=4), "mse", "mse_std", digits=2)


@query("SELECT quality AS truth, toxic AS guess, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return r6(agg.confusion(table(spark, sf, "labels"), "quality", "toxic"), "share")


@query("""
WITH s AS (SELECT (o_orderstatus = 'F')::INT AS y, o_totalprice AS v FROM orders),
r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r
""")
def rank_auc(spark, sf):
    return r6(agg.rank_auc(table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("v")), "y", "v"), "auc")


@query("""
SELECT l_linestatus, l_returnflag, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))
""")
def grouping_sets_dists(spark, sf):
    return r6(agg.grouping_stats(table(spark, sf, "lineitem"), [[], ["l_returnflag"], ["l_linestatus"]], "l_extendedprice"), "mean", digits=4)


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS c_l_extendedprice, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS c_l_tax FROM lineitem GROUP BY 1")
def weighted_centroid(spark, sf):
    return r6(r6(agg.centroids(table(spark, sf, "lineitem"), "l_returnflag", ("l_extendedprice", "l_tax"), F.col("l_quantity")), "c_l_extendedprice", digits=4), "c_l_tax")


@query("SELECT l_orderkey, l_linenumber, round(l_tax - avg(l_tax) OVER (PARTITION BY l_orderkey), 6) + 0.0::DOUBLE AS l_tax FROM lineitem")
def centred_atoms(spark, sf):
    return r6(agg.centred(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), "l_orderkey", ("l_tax",)), "l_tax").withColumn("l_tax", F.col("l_tax") + 0.0)


@query("""
WITH n AS (SELECT n_nationkey FROM nation), c AS (SELECT c_nationkey, sum(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT n_nationkey, round(coalesce(v, 0), 4) AS value FROM n LEFT JOIN c ON n_nationkey = c_nationkey
""")
def dense_group_sum(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return r6(agg.dense_reduce(table(spark, sf, "nation"), c, "n_nationkey", "c_acctbal"), "value", digits=4)


@query("SELECT l_orderkey, round(sum(p_retailprice), 4) AS mass, count(*)::BIGINT AS n_atoms FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def element_lookup(spark, sf):
    met = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return r6(met.groupBy("l_orderkey").agg(F.sum("p_retailprice").alias("mass"), F.count(F.lit(1)).alias("n_atoms")), "mass", digits=4)


@query("SELECT lang, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(n_chars), 4) AS mean_size FROM documents GROUP BY lang")
def composition_share(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_size"))
    return r6(r6(d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())), "share"), "mean_size", digits=4)


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR nx <> event_type
""")
def repeated_step_removal(spark, sf):
    return wn.last_of_runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""
WITH m AS (SELECT event_type, event_id, ts, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rm FROM events)
SELECT event_id, round(rm, 6) AS running, round(abs(rm - lag(rm) OVER w) / nullif(abs(lag(rm) OVER w), 0), 6) AS change FROM m WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def running_mean_convergence(spark, sf):
    e = table(spark, sf, "events").withColumn("running", wn.running_mean(["event_type"], ["ts", "event_id"], "value"))
    return r6(e.withColumn("change", wn.relative_change(["event_type"], ["ts", "event_id"], "running")).select("event_id", "running", "change"), "running", "change")


@query("""
WITH RECURSIVE o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT event_type, event_id, i, value AS s, 1.0::DOUBLE AS w FROM o WHERE i = 1
      UNION ALL SELECT o.event_type, o.event_id, o.i, e.s * 0.9 + o.value, e.w * 0.9 + 1 FROM e JOIN o ON o.event_type = e.event_type AND o.i = e.i + 1)
SELECT event_id, round(s / w, 6) AS ema FROM e
""")
def decayed_mean(spark, sf):
    return r6(wn.decayed_mean(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value", 0.1).select("event_id", "ema"), "ema")


@query("""
WITH w AS (SELECT event_id, value, event_type, ts FROM events)
SELECT event_id, round((value * 1 + coalesce(lag(value) OVER x, 0) * exp(-0.5 * 4) + coalesce(lag(value, 2) OVER x, 0) * exp(-0.5 * 16) + coalesce(lead(value) OVER x, 0) * exp(-0.5 * 4) + coalesce(lead(value, 2) OVER x, 0) * exp(-0.5 * 16))
  / (1 + (CASE WHEN lag(value) OVER x IS NULL THEN 0 ELSE exp(-0.5 * 4) END) + (CASE WHEN lag(value, 2) OVER x IS NULL THEN 0 ELSE exp(-0.5 * 16) END) + (CASE WHEN lead(value) OVER x IS NULL THEN 0 ELSE exp(-0.5 * 4) END) + (CASE WHEN lead(value, 2) OVER x IS NULL THEN 0 ELSE exp(-0.5 * 16) END)), 6) AS smooth
FROM w WINDOW x AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def gaussian_smooth(spark, sf):
    return r6(table(spark, sf, "events").withColumn("smooth", wn.gaussian_smooth(["event_type"], ["ts", "event_id"], "value", 0.5)).select("event_id", "smooth"), "smooth")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events), l AS (SELECT * FROM r WHERE i <= 100 AND value > 0),
q AS (SELECT event_type, quantile_cont(value, 0.95) AS q FROM l GROUP BY 1)
SELECT l.event_type, round(regr_slope(log10(value), -i), 8) AS slope FROM l JOIN q ON l.event_type = q.event_type WHERE value <= q GROUP BY 1
""")
def convergence_trend(spark, sf):
    return r6(wn.trend(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value", 100), "slope", digits=8)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20")
def topk_aligned(spark, sf):
    return wn.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], 20)


@query("""
WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), k AS (SELECT DISTINCT floor(k * (SELECT count(*) - 1 FROM part) / 99.0)::BIGINT AS place FROM (SELECT unnest(range(0, 100)) AS k))
SELECT p_partkey FROM r JOIN k ON place = i
""")
def even_sample(spark, sf):
    return wn.even_sample(table(spark, sf, "part"), "p_partkey", 100).select("p_partkey")


@query("SELECT ((row_number() OVER (ORDER BY o_orderkey)) - 1) % 8 AS chunk, o_orderkey FROM orders")
def strided_chunks(spark, sf):
    return wn.with_position(table(spark, sf, "orders"), "o_orderkey").select(F.pmod("_pos", F.lit(8)).alias("chunk"), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= (SELECT count(*) - floor(0.8 * count(*)) FROM orders) THEN 'test' ELSE 'train' END AS split FROM orders")
def train_test_split(spark, sf):
    return wn.split_first(table(spark, sf, "orders"), "o_orderkey", 0.8).select("o_orderkey", "split")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 10 = 0")
def every_nth_frame(spark, sf):
    return wn.every_nth(table(spark, sf, "events"), "event_id", 10).select("event_id")


@query("SELECT l_orderkey AS graph, n, (coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1)")
def batch_offsets(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("graph")).agg(F.count(F.lit(1)).alias("n"))
    return lay.offsets(n, "graph", "n").select("graph", "n", "offset")


@query("""
(SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' ORDER BY o_orderkey LIMIT 5000) UNION ALL
SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01' ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT greatest(0, 5000 - (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01')))
""")
def replay_buffer(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("2000-06-01").cast("timestamp")
    return st.replay_buffer(o.filter(F.col("o_orderdate") >= cut), o.filter(F.col("o_orderdate") < cut), "o_orderkey", 5000).select("o_orderkey")


@query("SELECT c_custkey, unnest(range(0, c_nationkey % 4))::INT AS copy FROM customer WHERE c_nationkey % 4 > 0")
def ragged_repeat(spark, sf):
    return lay.repeat_rows(table(spark, sf, "customer").withColumn("n", F.col("c_nationkey") % 4), "n").select("c_custkey", "copy")


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_quantity, l_linenumber) AS order_of FROM lineitem GROUP BY 1")
def aunit_sort(spark, sf):
    out = lay.to_lists(table(spark, sf, "lineitem"), "l_orderkey", ["l_quantity", "l_linenumber"], [])
    return out.select("l_orderkey", F.array_join(F.transform("items", lambda x: x["l_linenumber"].cast("string")), ",").alias("order_of"))


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS index FROM lineitem")
def list_round_trip(spark, sf):
    out = lay.to_rows(lay.to_lists(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], []))
    return out.select("l_orderkey", "l_linenumber", "index")


@query("SELECT pos, n_nationkey, n_name FROM (VALUES (0::BIGINT, 3), (1, 7), (2, 3), (3, 24)) AS t(pos, k) JOIN nation ON n_nationkey = k")
def gather_with_duplicates(spark, sf):
    picks = spark.createDataFrame([(0, 3), (1, 7), (2, 3), (3, 24)], "pos long, n_nationkey int")
    return lay.gather(table(spark, sf, "nation"), picks, "n_nationkey").select("pos", "n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 25, n_name FROM nation WHERE n_regionkey = 1")
def append_batch(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return lay.append(n, n.filter("n_regionkey = 1"), "n_nationkey").select("n_nationkey", "n_name")


@query("""
SELECT a.n_nationkey AS i, b.n_nationkey AS j, CASE WHEN a.n_regionkey = 4 OR b.n_regionkey = 4 THEN -1 ELSE least(a.n_nationkey, b.n_nationkey) * 25 - (least(a.n_nationkey, b.n_nationkey) * (least(a.n_nationkey, b.n_nationkey) - 1)) // 2 + abs(a.n_nationkey - b.n_nationkey) END::BIGINT AS idx
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey
""")
def triangular_pair_index(spark, sf):
    a = table(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("i"))
    met = a.join(a.withColumnRenamed("i", "j"), "n_regionkey")
    ok = F.col("n_regionkey") != 4
    return met.select("i", "j", m.pair_index(F.when(ok, F.col("i")), F.when(ok, F.col("j")), 25).alias("idx"))


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS src, c_custkey % 25 AS dst FROM customer), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
c0 AS (SELECT n_nationkey AS n, md5(n_regionkey::VARCHAR) AS c FROM nation),
c1 AS (SELECT n, md5(any_value(c) || '|' || coalesce(string_agg(d, ',' ORDER BY d), '')) AS c FROM (SELECT c0.n, c0.c, x.c AS d FROM c0 LEFT JOIN b ON src = c0.n LEFT JOIN c0 x ON x.n = dst) GROUP BY n)
SELECT n AS n_nationkey, c AS colour FROM c1
""")
def wl_refinement(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).alias("dst"))
    return cl.colour_refinement(table(spark, sf, "nation"), e, "n_nationkey", "n_regionkey", rounds=1)


@query("""
WITH d AS (SELECT r_regionkey, n_nationkey, md5(r_regionkey::VARCHAR || '|' || n_nationkey::VARCHAR) AS h FROM region, nation)
SELECT r_regionkey, n_nationkey FROM d ORDER BY h, r_regionkey, n_nationkey LIMIT 40
""")
def cartesian_search_space(spark, sf):
    return it.search_space(table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "region").select("r_regionkey"), 40, "r_regionkey", "n_nationkey").select("r_regionkey", "n_nationkey")


@query("""
WITH d AS (SELECT p_partkey, p_retailprice * (1 + 0.1 * (('0x' || substr(md5('3|' || p_partkey::VARCHAR || '|' || k::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)) AS v FROM part, (SELECT unnest(range(0, 50)) AS k))
SELECT p_partkey, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM d GROUP BY 1
""")
def mc_dropout_agg(spark, sf):
    d = it.draws(table(spark, sf, "part"), 50).withColumn("v", F.col("p_retailprice") * (1 + 0.1 * m.hashed_uniform(F.lit(3), F.col("p_partkey"), F.col("draw"))))
    return r6(pg.dropout_mean(d, "p_partkey", "v"), "mean", "std")


@query("""
WITH hit AS (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr'))
SELECT doc_id, 'kept' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit) UNION ALL SELECT doc_id, 'both' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'either' FROM (SELECT doc_id FROM hit UNION SELECT doc_id FROM labels)
""")
def anti_join_eval(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id")
    hit = d.filter(F.col("lang").isin("de", "fr")).select("doc_id")
    parts = [st.complement(d, hit, "doc_id").select("doc_id", F.lit("kept").alias("side")), d.select("doc_id").intersect(lab).select("doc_id", F.lit("both").alias("side")), hit.union(lab).distinct().select("doc_id", F.lit("either").alias("side"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH x AS (SELECT s_suppkey, s_acctbal / 10 + 900 AS v FROM supplier)
SELECT s_suppkey, p_partkey, round(gap, 6) AS gap FROM (SELECT s_suppkey, p_partkey, abs(v - p_retailprice) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(v - p_retailprice), p_partkey) AS r FROM x, part) WHERE r = 1
""")
def nearest_value_join(spark, sf):
    s = table(spark, sf, "supplier").withColumn("v", F.col("s_acctbal") / 10 + 900)
    return r6(jn.nearest_value_join(s, table(spark, sf, "part"), "v", "p_retailprice", "p_partkey", "s_suppkey"), "gap")


@query("""
SELECT event_id, k, v FROM (SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS v, 'k' AS k FROM events)
""")
def parse_tokens(spark, sf):
    return table(spark, sf, "events").select("event_id", F.lit("k").alias("k"), F.get_json_object("props", "$.k").cast("long").alias("v"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'a_to_b' ELSE 'b_to_c' END AS channel, l_shipdate IS NOT NULL AS dated FROM lineitem
""")
def channel_labels(spark, sf):
    x = F.when(F.col("l_suppkey") % 3 == 0, "a").otherwise("b")
    y = F.when(F.col("l_suppkey") % 3 == 0, "b").otherwise("c")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.channel(x, y).alias("channel"), F.col("l_shipdate").isNotNull().alias("dated"))
