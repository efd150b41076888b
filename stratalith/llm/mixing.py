"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is the repetition rate that brings
its source to its target weight. The number comes from inverting the distribution at a uniform
value hashed from (seed, doc_id), so a rerun, a retry or another partitioning gives the same rows.
The copies are then shuffled globally by a hash key.

Defined results: a null source is a source of its own; a null text counts as empty; rows with one
doc_id draw the same number; a null doc_id draws as the text ``null``; an empty table gives an empty
table; a source whose target weight is 0 or is missing from ``weights`` gives no rows. Columns of the
input are kept; ``copy``, ``n_copies`` and ``shuffle_key`` replace input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Distribution tables of up to so many values in all (8 bytes each) are broadcast; larger ones are joined by shuffle.
SMALL_TABLES = 1_000_000


def uniform(*parts):
    """A value in [0, 1) from the md5 of the parts: 52 bits, the same in any engine."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_rates(docs: DataFrame, source: str, weights: dict | None, alpha: float, epochs: float) -> DataFrame:
    """(source, mean): documents per source brought to the target weight. Sources without documents don't appear."""
    n = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    if weights is None:
        share = F.pow("_n", F.lit(alpha))
    else:
        share = F.coalesce(*(F.when(F.col("_source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()), F.lit(0.0))
    n = n.withColumn("_w", share)
    total = n.agg(F.sum("_w").alias("_sw"), F.sum("_n").alias("_sn"))
    return n.crossJoin(F.broadcast(total)).select("_source", (F.col("_w") / F.col("_sw") * F.col("_sn") * F.lit(epochs) / F.col("_n")).alias("_mean"))


def last_value():
    """Up to where a source's distribution function is listed: far into the upper tail."""
    return F.ceil(F.col("_mean") + 12 * F.sqrt("_mean") + 30).cast("int")


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, cdf array): the distribution function at 0, 1, ..., ``last_value``."""
    k = rates.filter("_mean > 0").select("_source", "_mean", F.explode(F.sequence(F.lit(0), last_value())).alias("_k"))
    by = W.partitionBy("_source").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    logs = k.withColumn("_f", F.sum(F.ln(F.greatest(F.col("_k"), F.lit(1)).cast("double"))).over(by))
    pmf = logs.withColumn("_p", F.exp(F.col("_k") * F.ln("_mean") - F.col("_mean") - F.col("_f")))
    return pmf.withColumn("_c", F.sum("_p").over(by)).groupBy("_source").agg(F.sort_array(F.collect_list("_c")).alias("_cdf"))


def poisson_mix(docs: DataFrame, *, weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Every document repeated by its Poisson number and shuffled globally.

    weights: target share by source; without it, shares follow (documents of the source) ** alpha.
    epochs: expected rows out, as a multiple of the rows in.
    """
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    rates = source_rates(docs, source, weights, alpha, epochs)
    tables = poisson_tables(rates)
    if (rates.agg(F.sum(last_value())).first()[0] or 0) <= SMALL_TABLES:
        tables = F.broadcast(tables)
    u = uniform(F.lit(seed), F.col(id_col))
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).cast("string").alias("_id"), F.col(source).alias("_of"), u.alias("_u"))
    drawn = rows.join(tables, F.col("_of").eqNullSafe(F.col("_source")))
    drawn = drawn.withColumn("n_copies", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))).cast("long")).filter("n_copies > 0")
    out = drawn.select("whole", "_id", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce("_id", F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    return out.select("whole.*", "n_copies", "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sql(docs: str, columns: str) -> str:
    """DuckDB SQL of poisson_mix with its defaults, over the table or subquery ``docs``."""
    return f"""
    WITH RECURSIVE d AS (SELECT * FROM {docs}),
    n AS (SELECT source, count(*)::DOUBLE AS n FROM d GROUP BY source),
    rate AS (SELECT source, pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM n) * (SELECT sum(n) FROM n) * 1.0 / n AS mean FROM n),
    k AS (SELECT source, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::INT + 1)) AS k FROM rate),
    f AS (SELECT source, mean, k, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS f FROM k),
    c AS (SELECT source, sum(exp(k * ln(mean) - mean - f)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM f),
    cdf AS (SELECT source, list(c) AS cdf FROM c GROUP BY source),
    u AS (SELECT d.*, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0)) AS n_copies
          FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
    r AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM u WHERE n_copies > 0)
    SELECT {columns}, n_copies::BIGINT AS n_copies, copy::BIGINT AS copy,
           md5('17-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR) AS shuffle_key FROM r
    """


QUERIES = {"op7_poisson_mix": op7_poisson_mix}
ORACLE_SQL = {"op7_poisson_mix": mix_sql("documents", "doc_id, text, lang, source, n_chars")}
