"""Rows with one id are told apart by 64 bits of their text's hash; 31 bits meet among thousands of rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stratalith.llm import anchors as an
from stratalith.llm import suffix_dedup as sx


def colliding(spark):
    """Two texts without a common passage whose hashes agree in the lower 31 bits."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), i.cast("string"))), 1, 8)))
    t = spark.range(300_000).select(words.alias("text")).withColumn("low", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))
    met = t.groupBy("low").agg(F.sort_array(F.collect_list("text")).alias("texts")).filter(F.size("texts") > 1)
    return met.orderBy("low").first()["texts"][:2]


def test_texts_of_one_id_stay_apart(spark):
    one, two = colliding(spark)
    rows = [(None, one), (None, two), (7, "start " + one), (8, two[::-1] + " " + two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ties = {r.tie for r in docs.filter("doc_id IS NULL").select(*an.row_id(docs, "doc_id", "text")).collect()}
    assert len(ties) == 2
    # The null rows come first and stay; of the others goes what repeats either of them.
    out = sx.remove_repeated_bytes(docs).collect()
    kept = {r.doc_id: bytes(r.kept).decode() for r in out if r.doc_id is not None}
    assert one not in kept[7] and two not in kept[8]
    assert sorted(bytes(r.kept).decode() for r in out if r.doc_id is None) == sorted([one, two])
