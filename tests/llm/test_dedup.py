"""Repeats, near duplicates and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.llm import anchors as an
from stratalith.llm import decontaminate as dc
from stratalith.llm import ngram_join as nj
from stratalith.llm import substring_dedup as sd
from stratalith.llm import suffix_dedup as sx
from stratalith.llm import textkernel as tk
from stratalith.llm.graph import components
from stratalith.llm.registry import ORACLE_SQL, QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(rows):
    """Rows alike in id and text are one document."""
    return sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def brute_words(rows, length=35):
    docs = [(d, WORD.findall(t.encode())) for d, t in documents(rows)]
    seen = defaultdict(int)
    for _, w in docs:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] += 1
    out = {}
    for d, w in docs:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for d, t in documents(rows):
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        gone = gone[:-1]
        spans = int((np.diff(np.r_[False, gone, False].astype(int)) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_repeated_words(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    want = brute_words(rows)
    got = sd.remove_repeats(hard).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text.encode()) == want[r.doc_id], r.doc_id
        assert sum(b - a for a, b in r.spans) == r.n_removed


def test_repeated_bytes(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    want = brute_bytes(rows)
    got = sx.remove_repeated_bytes(hard).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("op", [sd.remove_repeats, sx.remove_repeated_bytes, nj.jaccard_components, nj.keep_one])
def test_empty_tables(op, none):
    assert op(none).count() == 0


def test_two_texts_of_one_id(spark):
    df = spark.createDataFrame([(1, "q" * 150), (1, "r" * 90), (2, "q" * 150)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in sx.remove_repeated_bytes(df).collect())
    assert got == [(1, 90, 0), (1, 150, 149), (2, 150, 150)]


def tokens(t):
    w = WORD.findall((t or "").lower().encode() if (t or "").isascii() else bytes((t or "").encode().translate(tk.LOWER.tobytes())))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_components(rows):
    sets = [(d, tokens(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), min(least[find(i)], default=None)) for i, (d, s) in enumerate(sets)]


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_components_of_documents(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(hard).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_a_large_group_of_near_copies(spark):
    """Enough members for pivots, some linked only through others."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(1, 6)):
            w[j] = f"n{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:12] + [f"m{i}_{j}" for j in range(9)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_signatures_lose_no_link():
    """Two sets at the threshold share a signature whose rests allow the pair, whatever is frequent."""
    rng = np.random.default_rng(0)

    def fresh(n):
        return rng.integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64)

    for n in (4, 5, 8, 12, 20, 60, 200, 1000):
        for share in (0.0, 0.5, 1.0):
            for own in (0, n // 16, n // 8):
                both = fresh(n - n // 4)
                a, b = np.r_[both, fresh(n // 4 - own)], np.r_[both, fresh(own)]
                if 100 * len(both) < 75 * (len(a) + len(b) - len(both)):
                    a, b = both, np.r_[both, fresh(len(both) // 3)]
                hot = lambda t: (tk.mix(t.copy()) % np.uint64(1000)) < np.uint64(int(share * 1000))
                sigs = []
                for t in (a, b):
                    t = np.sort(t)
                    t = t[np.lexsort((t, hot(t)))]
                    base = t[: len(t) // 4 + 1]
                    if hot(base).any():
                        sig, rest, _ = nj.signatures(t, hot(t), np.full(len(t), 7, np.uint8))
                        sigs.append(dict(zip(sig.tolist(), rest.tolist(), strict=True)))
                    else:
                        sigs.append({s: len(t) - i for i, s in enumerate(base.tolist())})
                met = sigs[0].keys() & sigs[1].keys()
                assert any(nj.possible(len(a), sigs[0][s], len(b), sigs[1][s]) for s in met), (n, share, own)


@pytest.mark.parametrize("many, salt", [(0, 0), (2, 1), (64, 12)])
def test_classes_and_salts_change_no_component(spark, monkeypatch, many, salt):
    """Mixtures of common lines, near copies of one text and texts mostly of common lines: brute force, whatever is frequent or salted."""
    for k, v in (("MANY", many), ("SALT_LEVEL", salt)):
        monkeypatch.setattr(nj, k, v)
    rng = np.random.default_rng(5)
    lines = [" ".join(f"l{i}w{j}" for j in range(8)) for i in range(24)]
    rows = [(i, "\n".join(lines[j] for j in sorted(rng.choice(24, rng.integers(4, 20), replace=False)))) for i in range(90)]
    base = [f"b{i}" for i in range(90)]
    for i in range(60):
        w = list(base[: rng.integers(60, 91)])
        for j in rng.integers(0, len(w), rng.integers(0, 5)):
            w[j] = f"n{i}_{j}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, "\n".join(lines[:10]) + f" {' '.join(f'own{i}_{j}' for j in range(rng.integers(1, 30)))}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(df).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_kept_rows_do_not_depend_on_names_or_order(spark):
    rows = [(1, "a b c d e f", "z", 1), (1, "a b c d e f", "y", 2), (2, "a b c d e f", "x", 3), (3, "q", "w", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string, root long")
    one, other = (sorted(tuple(r) for r in nj.keep_one(x).collect()) for x in (df, df.orderBy(F.desc("root")).repartition(2)))
    assert one == other and [r[0] for r in one] == [1, 3] and len(one[0]) == 4


def test_keep_one(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    comp = {(d, n, c) for d, n, c in brute_components(rows)}
    kept = sorted((r.doc_id for r in nj.keep_one(hard).collect()), key=str)
    assert kept == sorted({d for d, n, c in comp if d is None or d == c}, key=str)


def test_star_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(40, 41), (41, 42)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(26)) and got[42] == 40


def brute_contamination(docs, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans(dc.UPPER, dc.LOW)
    windows = defaultdict(set)
    for item, t in bench:
        w = word.findall((t or "").translate(low))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    out = []
    for d, t in docs:
        w, hit, items = word.findall((t or "").translate(low)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), sorted(items)))
    return out


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_contamination(spark, hard, rows):
    """Both the broadcast and the shuffle path."""
    bench = [(1, "One, two"), (2, "a-b-c d e f g h i j k l m"), (3, None), (4, "..."), (5, "a b c d e f g h i j"), (7, "two"), (6, "a b c d e f g h i j")]
    extra = [(100, "zz A b C, d e f g h i j k q"), (101, "one two"), (102, "b c d e f g h i j k l m n a b c d e f g h i j"), (103, "two two ONE two")]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in dc.decontaminate(docs, b, broadcast_rows=rows).collect()]
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], bench)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dc.drop_contaminated(docs, b, broadcast_rows=rows).count() == sum(not w[3] for w in want)
    assert dc.decontaminate(docs, b.limit(0), broadcast_rows=rows).filter("n_hit > 0").count() == 0


def test_anchor_windows_hold_one_anchor():
    """Each run of the length holds an anchor at a place that only its content decides."""
    rng = np.random.default_rng(1)
    runs = an.Runs(20, 6, "byte", True)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    both = np.r_[text, rng.integers(97, 100, 37).astype(np.uint8), text]
    offs = np.array([0, 400, 437, 837])
    sym, bounds = an.symbols(runs, both, offs)
    _, _, doc, pos = an.find(runs, sym, bounds)
    first, last = set(pos[doc == 0].tolist()), set(pos[doc == 2].tolist())
    assert first == last
    assert all(any(s <= p <= s + 14 for p in first) for s in range(381))


def test_intervals_against_comparison_of_all_strings():
    """Carried common prefixes mark the same strings as comparing each with each, texts that end nearby included."""
    rng = np.random.default_rng(7)
    runs = an.Runs(12, 4, "byte", True)
    side = runs.length - runs.gram
    for letters in (1, 2, 3):
        for m in (1, 2, 40):
            context = rng.integers(0, letters, (m, 2 * side + runs.gram)).astype(np.uint8)
            context[:, side : side + runs.gram] = 1
            context[m // 2 :, side:] = context[0, side:]
            sides = rng.integers(0, side + 1, (m, 2))
            sides[rng.random(m) < 0.6] = side
            for i in range(m):
                context[i, : side - sides[i, 0]] = 0
                context[i, side + runs.gram + sides[i, 1] :] = 0
            got = sx.expand_intervals(runs, np.zeros(m, np.uint64), context, sides)
            for o in range(side + 1):
                seen = set()
                for i in range(m):
                    string = context[i, side - o : side - o + runs.length].tobytes()
                    whole = sides[i, 0] >= o and sides[i, 1] >= side - o
                    assert got[i, o] == (whole and string in seen), (letters, m, o, i)
                    if whole:
                        seen.add(string)


def test_word_hashes_of_blocks():
    texts = ["ab  cd\tef", "", "ab", " x", "y "]
    raw = "".join(texts).encode()
    offs = np.cumsum([0] + [len(t) for t in texts])
    starts, ends, bounds = tk.words(np.frombuffer(raw, np.uint8), offs)
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"ab", b"x", b"y"]
    assert np.diff(bounds).tolist() == [3, 0, 1, 1, 1]
    h = tk.span_hash(np.frombuffer(raw, np.uint8), starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_oracles(spark, small, name):
    import duckdb

    from compare import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    rel = con.sql(ORACLE_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_digest_matches_the_kept_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = QUERIES["op3_remove_repeats"](spark, small).filter("n_removed = 0").join(docs.select("doc_id", "text"), "doc_id").first()
    assert one.kept_sha256 == hashlib.sha256(b" ".join(WORD.findall(one.text.encode()))).hexdigest()
    assert docs.filter(F.col("text").isNull()).count() >= 0
