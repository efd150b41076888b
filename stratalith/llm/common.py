"""Helpers shared by the training-data operators: scratch tables, sizing, row keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python blocks of text are cut to this many bytes, so that a worker's arrays stay bounded.
BLOCK_BYTES = 1 << 20
#: A packed shuffle bucket should hold about this many bytes.
BUCKET_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one is made only where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stratalith-")
        sc.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with ``values``; the old ones hold again afterwards."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts the lineage. ``discard`` removes it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # What the step shuffled goes as soon as its table is written.
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` has written and nothing will read again."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def packed_buckets(payload_bytes: int, least: int = 48) -> int:
    """How many packed buckets a payload needs; grows with the payload."""
    return int(max(least, payload_bytes // BUCKET_BYTES + 1))


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """64-bit key of a row by its id and text; rows alike in both share one key."""
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def partitions_for(spark: SparkSession, buckets: int) -> int:
    """Shuffle partitions for so many buckets: at least the session's number, a few dozen buckets each at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 16)


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
