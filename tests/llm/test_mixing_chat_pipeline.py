"""Replication, chat rendering, and the pipeline stage by stage."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stratalith.llm import chat
from stratalith.llm import mixing as mx


def test_poisson_distribution(spark):
    t = {r._source: r._cdf for r in mx.poisson_tables(spark.createDataFrame([("a", 0.7), ("b", 40.0)], "_source string, _mean double")).collect()}
    for name, mean in (("a", 0.7), ("b", 40.0)):
        total = 0.0
        for k, c in enumerate(t[name][:60]):
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            assert c == pytest.approx(total)
        assert t[name][-1] == pytest.approx(1)


def test_weights_are_met(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 5000, "big").when(F.col("id") < 5900, "small").alias("source"))
    got = {r.source: r.n for r in mx.poisson_mix(docs, weights={"big": 0.5, "small": 0.4, None: 0.1}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["big"] == pytest.approx(3000, rel=0.06) and got["small"] == pytest.approx(2400, rel=0.06) and got[None] == pytest.approx(600, rel=0.15)
    only = mx.poisson_mix(docs, weights={"small": 1.0})
    assert {r.source for r in only.select("source").distinct().collect()} == {"small"}


def test_replication_is_the_same_in_any_partitioning(spark, hard, none):
    a, b = (sorted(map(str, mx.poisson_mix(d, epochs=2.0).collect())) for d in (hard, hard.repartition(7)))
    assert a == b and mx.poisson_mix(none).count() == 0
    clash = mx.poisson_mix(hard.withColumn("copy", F.lit(9)))
    assert clash.columns.count("copy") == 1


def test_order_is_global(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    ids = [r.doc_id for r in mx.poisson_mix(docs).collect()]
    moves = sum(a > b for a, b in zip(ids, ids[1:], strict=False))
    assert 0.4 * len(ids) < moves < 0.6 * len(ids)


def test_every_speaker_has_a_view(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, None, "x"), (3, 0, "system", "only"), (None, None, "cy", "lost"), (4, 70, "ann", "late"), (4, 1, "bob", "é")]
    got = {(r.conv_id, r.example, r.speaker): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (2, 0, "unknown"), (None, 0, "cy"), (4, 0, "ann"), (4, 0, "bob"), (4, 1, "ann"), (4, 1, "bob")}
    r = got[(1, 0, "bob")]
    assert r.text == "<|system|>\nrules\n<|end|>\n<|user:ann|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n<|user:ann|>\n\n<|end|>\n"
    assert [r.text[m.start : m.stop] for m in r["mask"]] == ["yo\n<|end|>"]
    assert [got[(1, 0, "ann")].text[m.start : m.stop] for m in got[(1, 0, "ann")]["mask"]] == ["hi\n<|end|>", "\n<|end|>"]
    assert got[(4, 0, "bob")].text == "<|assistant|>\né\n<|end|>\n"


def test_no_turns(spark):
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "source_weights"]
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = cp.materialize(stage(spark, before, small), name)
        assert after.columns == docs.columns
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        assert set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert after.join(before, docs.columns, "left_anti").count() == 0
        else:
            assert len(ids) == before.count() and after.filter("n_chars <> length(text)").count() == 0
        before = after
    whole = cp.run(spark, small)
    assert whole.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0


def test_pipeline_near_duplicates_and_passages_by_brute_force(spark, small, hard):
    from test_dedup import brute_bytes, brute_components, key

    rows = [(r.doc_id, r.text) for r in hard.collect()]
    kept = cp.near_duplicates(spark, hard, small)
    assert sorted([(r.doc_id, 0) for r in kept.collect()], key=key) == sorted({(d, 0) for d, _, c in brute_components(rows) if d is None or d == c}, key=key)
    want = brute_bytes([(r.doc_id, r.text) for r in kept.collect()])
    for r in cp.repeated_passages(spark, kept, small).collect():
        assert r.text == want[r.doc_id][3].decode(errors="ignore")


NAMES = {"row": "a", "kept": "b", "n_removed": "c", "_rid": "d", "_u": "e", "_source": "f", "stratum": "g", "whole": "h", "rid": "i", "node": "j", "_id": "k", "spans": "l", "_of": "m", "pos": "n", "rest": "o"}


def test_stages_keep_columns_of_any_name(spark, small):
    """No stage overwrites, loses or confuses an input column."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 6, "en", f"s{i % 3}", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, v in NAMES.items():
        docs = docs.withColumn(k, F.lit(v))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, small)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = out.collect()
        assert rows and all(r[k] == v for r in rows for k, v in NAMES.items()), name


def test_stages_on_odd_rows(spark, small):
    """Nulls in any column, empty and long texts, repeated rows, and an empty table."""
    import corpus_pipeline as cp

    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (2, "x y z " * 50_000, "en", None, 1), (3, "one two three", "en", "a", 1), (3, "one two three", "en", "a", 1), (4, None, "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name
        got = stage(spark, docs, small)
        assert got.columns[:5] == docs.columns and got.count() > 0, name


def test_cut_text_keeps_other_characters(spark):
    """Only characters that lose a byte go; a replacement character of the input stays."""
    from stratalith.llm.suffix_dedup import cut_repeated_text

    passage = "".join(chr(256 + i) for i in range(60))
    docs = spark.createDataFrame([(1, f"a\ufffd{passage}b"), (2, f"\ufffdc{passage}d\ufffd")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in cut_repeated_text(docs).collect()}
    assert got == {1: f"a\ufffd{passage}b", 2: "\ufffdcd\ufffd"}


def test_ids_that_are_not_integers_are_refused(spark):
    from stratalith.llm.suffix_dedup import remove_repeated_bytes

    with pytest.raises(TypeError):
        remove_repeated_bytes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
