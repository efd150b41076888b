"""Registration of queries with their oracles, and the stand-in tables they read.

The driver's tables stand for structures: lineitem rows are atoms of an order, part is the element table,
embeddings are points of a labelled graph, events are a trajectory, customer names are identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines give one value."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def points(spark: SparkSession, sf_dir: str, dims: int = 3) -> DataFrame:
    """(graph, point, x, y, z[, ...]): the first dimensions of the embeddings as coordinates."""
    names = "xyzuvw"[:dims]
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("graph"), F.col("vec_id").alias("point"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)))


POINTS_SQL = "p AS (SELECT label AS graph, vec_id AS point, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
PAIRS_SQL = POINTS_SQL + """,
e AS (SELECT a.graph, a.point AS i, b.point AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
      FROM p a JOIN p b ON a.graph = b.graph AND a.point <> b.point)"""
