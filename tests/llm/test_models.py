"""Learned operators: held-out accuracy, exact bounds, automata against plain edit distance."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalith.llm import features as ft
from stratalith.llm import language_id as li
from stratalith.llm import quality_gam as qg
from stratalith.llm import quality_rules as qr
from stratalith.llm import toxicity as tox
from stratalith.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def brute_counts(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, dup, old = text.split("\n"), 0, set()
    for x in lines:
        if x.strip(" \t\n\v\f\r"):
            dup += x in old
            old.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts(hard, none):
    got = ft.text_counts(hard.withColumn("whole", F.col("text")), carry=("whole",)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.whole)
    assert ft.text_counts(none).count() == 0


def test_query_op1_by_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op1_quality_rules"](spark, small).collect():
        n, chars, symbols, dup, rep = brute_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_exact_bounds():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (5, 5, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert qr.binomial_tail(k, n, p) == pytest.approx(want)
    u = qr.upper_bound(2, 50, 0.05)
    assert qr.binomial_tail(2, 50, u) == pytest.approx(0.05, abs=1e-6)


def test_cutoffs_stop_at_the_first_unproven_one():
    rows = [{"stratum": s, "n": n} | {f"{r}_{i}": 0 for r, (_, _, g) in qr.RULES.items() for i in range(len(g))} for s, n in (("en", 5000), ("xx", 20))]
    rows[0]["symbols_3"] = 400
    got = {r["stratum"]: qr.choose_cutoffs(r, len(rows), 0.05, 0.05) for r in rows}
    assert got["en"]["symbols"] == qr.RULES["symbols"][2][2] and got["xx"] == {}


def test_false_rejection_is_limited(spark):
    """Over repeated draws, a rule that truly rejects more than its share is chosen in at most delta of them."""
    rng, bad = np.random.default_rng(0), 0
    for _ in range(300):
        row = {"stratum": "s", "n": 1000} | {f"{r}_{i}": 1000 for r, (_, _, g) in qr.RULES.items() for i in range(len(g))}
        row["symbols_0"] = int(rng.binomial(1000, 0.011))
        bad += bool(qr.choose_cutoffs(row, 1, 0.05, 0.05))
    assert bad <= 300 * 0.05


def test_rules_on_odd_tables(spark, hard, none):
    out = qr.apply_rules(hard, labels(spark))
    assert out.count() == hard.count() and out.filter("NOT base_failed AND NOT kept").count() == 0
    assert qr.apply_rules(none, labels(spark)).count() == 0
    assert qr.apply_rules(hard.withColumn("lang", F.lit(None).cast("string")), labels(spark, [(1, 1, None), (1, None, 0)])).count() == hard.count()


def near(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    terms = [("idiot", False), ("scum", False), ("worthless", False), ("lowei", True)]
    auto, rng = tox.Automaton(terms), random.Random(1)
    words = [b"idiot", b"idot", b"idiiot", b"1diot", b"idiots", b"scum", b"scam", b"worthles", b"loweiabc", b"lowexabc", b"lowi", b"zzz", b"i"]
    for _ in range(400):
        w = list(rng.choice([b"idiot", b"scum", b"worthless", b"loweixy"]))
        for _ in range(rng.randrange(3)):
            at, what = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (what > 0)] = [rng.randrange(97, 123)] if what < 2 else []
            w = w or [97]
        words.append(bytes(w))
    data = np.frombuffer(b" ".join(words), np.uint8)
    edge = np.cumsum([0] + [len(w) + 1 for w in words])
    got = auto.match(data, edge[:-1], edge[1:] - 1)
    for w, k in zip(words, got, strict=True):
        exact = w in (b"idiot", b"scum", b"worthless")
        fuzzy = min(near(w, t) for t in (b"idiot", b"worthless")) <= 1
        near_stem = any(near(w[:i], b"lowei") <= 1 for i in range(len(w) + 1))
        # Short terms have no edits: ``scam`` is no hit.
        may = {tox.STEM} if w.startswith(b"lowei") else {tox.WORD} if exact else ({tox.NEAR} if fuzzy else set()) | ({tox.NEAR_STEM} if near_stem else set()) or {tox.NONE}
        assert k in may, (w, k)


def toxic_corpus(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        w = [f"w{rng.randrange(3000)}q" for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["grublin", "snorkest"])
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)


def test_toxicity_catches_misspelled_terms_and_weighs_quotes(spark):
    docs, marks = toxic_corpus(spark)
    model = tox.learn_toxicity(docs, marks)
    new = ["w1q w2q you grublim and snorkkest " + "w3q " * 20, "w1q w2q plain words " + "w3q " * 20, 'w1q he said "you grublin" w2q ' + "w3q " * 20, "", "w1q he you grublin w2q " + "w3q " * 20]
    quoted = [f"w1q {a}you grublin there{b} w2q " + "w3q " * 20 for a, b in ('""', "''", "“”", "„“", "«»", "‘’", "‹›")]
    not_quoted = ["w1q don't you grublin, it's w2q " + "w3q " * 20, 'w1q "w2q" you grublin "w4q" ' + "w3q " * 20]
    x = model.features(pa.array(new + quoted + not_quoted))
    s = model.scores(x)
    at = {n: i for i, n in enumerate(tox.FEATURES)}
    assert s[0] > 0.5 > s[1] and s[3] < 0.5
    assert x[2][at["quoted"]] == 1 and x[2][at["reported"]] == 1 and x[0][at["quoted"]] == 0
    # One term counts as abuse alone, and doesn't in a reported quotation.
    assert s[2] < 0.5 < s[4]
    k = len(new)
    assert (x[k : k + len(quoted), at["quoted"]] == 1).all() and (s[k : k + len(quoted)] < s[4]).all()
    assert (x[k + len(quoted) :, at["quoted"]] == 0).all()
    assert (model.weights[:-1] >= 0).all() and model.weights[:-1].max() > 0


def test_terms_with_common_neighbours_match_exactly():
    assert tox.one_edit(b"idiot", b"idoit") is False and tox.one_edit(b"idiot", b"idiots") and tox.one_edit(b"idiot", b"idit") and tox.one_edit(b"idiot", b"idxot") and tox.one_edit(b"ab", b"ab")
    both = tox.Automaton([("loser", False), ("idiot", False)], frozenset({("loser", False)}))
    words = [b"loser", b"closer", b"idiot", b"idiott"]
    edge = np.cumsum([0] + [len(w) for w in words])
    assert both.match(np.frombuffer(b"".join(words), np.uint8), edge[:-1], edge[1:]).tolist() == [tox.WORD, tox.NONE, tox.WORD, tox.NEAR]


def test_toxicity_on_odd_tables(spark, hard, none):
    docs, marks = toxic_corpus(spark)
    assert tox.score_toxicity(hard, labels(spark)).filter("score = 0").count() == hard.count()
    assert tox.score_toxicity(none, marks).count() == 0
    kept = tox.drop_toxic(docs.withColumn("score", F.lit("mine")), marks)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id % 6 == 0 for r in kept.collect()} == {False}


def test_toxicity_held_out(spark):
    """Labels have noise: some documents marked toxic hold nothing of the kind."""
    larger = "/root/testdata/sf0.1"
    out = QUERIES["op5_toxicity"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").filter("held_out").persist()
    found, marked, both = (out.filter(c).count() for c in ("predicted = 1", "toxic = 1", "predicted = 1 AND toxic = 1"))
    assert both >= 0.95 * found and both >= 0.88 * marked


def test_repeated_ids_and_long_texts_in_fits(spark):
    """Rows that repeat an id don't grow what is learned from; very long texts and null ids are scored."""
    docs, marks = toxic_corpus(spark)
    long = spark.createDataFrame([(None, "grublin " * 100_000), (1, "w1q " * 300_000), (1, "other text")], "doc_id long, text string")
    out = tox.score_toxicity(docs.unionByName(long), marks).collect()
    assert len(out) == 603 and all(0 <= r.score <= 1 for r in out)
    assert [r.score > 0.5 for r in out if r.doc_id is None] == [True]
    repeated = docs.unionByName(docs).withColumn("lang", F.lit("en"))
    assert qg.score_quality(repeated, marks).count() == 1200
    assert li.identify(repeated).filter("lang_pred = 'en'").count() == 1200


def test_quality_held_out(spark):
    out = QUERIES["op8_quality_gam"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    out = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    assert out.filter("predicted = quality").count() >= 0.93 * out.count()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = qg.Gam(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in model.pairs


def test_gam_on_odd_tables(spark, hard, none):
    assert {r.score for r in qg.score_quality(hard, labels(spark)).collect()} == {0.5}
    assert qg.score_quality(none, labels(spark, [(1, 1, 0)])).count() == 0
    assert qg.score_quality(hard, labels(spark, [(1, 1, 0), (1, 0, 0), (99, 1, 0), (None, 1, 1)])).count() == hard.count()


def test_language_held_out(spark):
    out = QUERIES["op10_identify"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count()
    assert out.filter("accepted AND lang_pred <> lang").count() <= 0.02 * out.count()


def test_language_without_letters(spark, none):
    docs = spark.createDataFrame([(1, "123 456", "en"), (2, None, "en"), (3, "", "en"), (4, "straße über", "de"), (6, "the house", "en"), (7, "жук", None), (8, "haus über", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[7][0] in ("de", "en")
    assert li.identify(none).count() == 0
    assert {r.lang_pred for r in li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_nothing_is_learned_from_held_out_rows(spark):
    got = {r.doc_id: r.h for r in spark.range(200).select(F.col("id").alias("doc_id"), ft.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}
    known = ft.learning_sample(labels(spark, [(i, 1, 0) for i in range(200)]), "quality", 50).collect()
    assert len(known) == 50 and not any(got[r.doc_id] for r in known)
