"""Toxicity by a Levenshtein automaton over a lexicon trie, with context windows.

The lexicon is learned: words of 4 to 24 bytes and word stems (4 to 6 letters) that toxic documents of a bounded labelled
sample hold and others don't. A term needs support by several words before it, so words of one text and its copies don't count as terms. Its trie is intersected with the Levenshtein automaton of one edit (in bytes) and made
deterministic; all words of a block of texts run through that one table a byte at a time, so misspelled
terms are caught as the exact ones are. Words under ``FUZZY_LEAST`` bytes match exactly only, and so do terms whose misspelled
forms are common in the sample's other documents.

Each hit is weighed by its window of words: within quotation marks (straight, curly, single, guillemets) it counts as
QUOTED of a hit, beside a word of report as REPORTED of one, with both as their product. These two are set, not learned: labels
with quoted terms are too few to learn from. Hits close to one another count as a burst. The weighed numbers of hits and
of stem hits, the densest window and the share of hits enter a logistic regression, fitted on the same sample, none of whose
weights is negative: a further hit of any kind never makes a text less toxic.

The sample holds at most ``sample`` labelled rows, the first by a hash of the id, never ones whose
crc32(doc_id) mod 5 is 0. Only text enters a score.

Defined results: a null or empty text has no hits and gets the score of such texts; null labels aren't used,
repeated labels of a document count as the highest; of rows that repeat an id the one with the least text hash is learned from, all are scored; without labels of both kinds all scores are 0; empty tables
give empty tables.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import discard, materialize
from .features import held_out, learning_sample, per_doc

SAMPLE, TERMS, LEAST_DOCS, PRECISION, WINDOW, FUZZY_LEAST = 8_000, 200, 6, 0.9, 12, 5
#: What a hit within quotation marks, and one beside a word of report, counts.
QUOTED, REPORTED = 0.25, 0.4
#: Fixed: words that report another's words, in the languages of the corpus.
REPORTING = ("said", "says", "wrote", "called", "quote", "quoted", "sagte", "schrieb", "dit", "dijo", "escribió", "écrit")
NONE, WORD, NEAR, STEM, NEAR_STEM = range(5)
#: The regression takes the first FITTED; numbers of misspelled, quoted and reported hits are given, and count in the others.
FEATURES = ("hits", "stems", "densest", "share", "near_words", "near_stems", "quoted", "reported")
FITTED = 4
#: Fixed: quotation marks of two and three bytes.
WIDE_MARKS = ("«", "»", "‘", "’", "‚", "‛", "“", "”", "„", "‟", "‹", "›")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile("|".join(WIDE_MARKS).encode())


def terms_of(batches):
    """Documents by term and label, added up within a partition, and the words before the term as bits of a hash. A term is a word, or a stem of one; its first place in a text counts."""
    counts: dict[tuple[bytes, bool, int], list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen: dict[tuple[bytes, bool], int] = {}
            before = b""
            for w in _WORD.findall(_MARK.sub(b" ", (text or "").encode()).translate(tk.LOWER.tobytes())):
                if 4 <= len(w) <= 24 and (w, False) not in seen:
                    bit = 1 << zlib.crc32(before) % 63
                    seen[w, False] = bit
                    s = w.decode()
                    for n in (4, 5, 6):
                        if len(s) > n:
                            seen.setdefault((s[:n].encode(), True), bit)
                before = w
            for (w, stem), bit in seen.items():
                own = counts.setdefault((w, stem, label), [0, 0])
                own[0] += 1
                own[1] |= bit
        if len(counts) > 400_000:
            yield from flushed(counts)
    yield from flushed(counts)


def flushed(counts: dict):
    if counts:
        w, stem, label = zip(*counts, strict=True)
        n, bits = zip(*counts.values(), strict=True)
        columns = [pa.array([x.decode() for x in w]), pa.array(stem), pa.array(label, pa.int32()), pa.array(n, pa.int64()), pa.array(bits, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "stem", "label", "n", "bits"])
        counts.clear()


def choose_terms(rows: list[tuple[str, bool, int, int]], most: int = TERMS) -> list[tuple[str, bool]]:
    """rows: (term, is stem, toxic documents, others). The most frequent precise terms; none that a chosen stem implies."""
    words = {t: n for t, stem, n, _ in rows if not stem}
    kept: list[tuple[str, bool]] = []
    for term, stem, n, _ in sorted(rows, key=lambda r: (-r[2], len(r[0]), r[0], r[1])):
        if any(s and term.startswith(t) for t, s in kept):
            continue
        # A stem that stands for one word only is that word.
        if stem and any(w.startswith(term) and m >= 0.8 * n for w, m in words.items()):
            continue
        kept.append((term, stem))
        if len(kept) == most:
            break
    return kept


class Automaton:
    """Trie of the lexicon times the Levenshtein automaton of one edit, as one table: state, byte -> state."""

    def __init__(self, terms: list[tuple[str, bool]], exact: frozenset[tuple[str, bool]] = frozenset()):
        children: list[dict[int, int]] = [{}]
        whole, stem, fuzzy, long = set(), set(), set(), set()
        for term, is_stem in terms:
            node, raw = 0, term.encode()
            for c in raw:
                if c not in children[node]:
                    children.append({})
                    children[node][c] = len(children) - 1
                node = children[node][c]
                if len(raw) >= FUZZY_LEAST and (term, is_stem) not in exact:
                    fuzzy.add(node)
            (stem if is_stem else whole).add(node)
            if len(raw) >= FUZZY_LEAST and (term, is_stem) not in exact:
                long.add(node)
        below = {0} | fuzzy  # nodes on the way to a term that is long enough for an edit

        def closed(states):
            """With a letter of the term left out."""
            out = set(states)
            for node, edits in states:
                if edits == 0:
                    out.update((child, 1) for child in children[node].values() if child in below)
            return frozenset(x for x in out if x[1] == 0 or (x[0], 0) not in out)

        def step(states, c):
            out = set()
            for node, edits in states:
                if c in children[node] and (edits == 0 or children[node][c] in below):
                    out.add((children[node][c], edits))
                if edits == 0:
                    if node in below:
                        out.add((node, 1))
                    out.update((child, 1) for child in children[node].values() if child in below)
            return closed(out)

        alphabet = sorted({c for kids in children for c in kids})
        other = next(c for c in range(256) if c not in set(alphabet))
        known = {frozenset(): 0}
        start = closed({(0, 0)})
        known[start] = 1
        table, todo, self.kind = [np.zeros(256, np.int32)], [start], [NONE]
        while todo:
            states = todo.pop(0)
            row = np.zeros(256, np.int32)
            kind = NONE
            for node, edits in states:
                if node in stem and (edits == 0 or node in long):
                    kind = max(kind, STEM if not edits else NEAR_STEM, key=lambda k: (k in (STEM, NEAR_STEM), k == STEM))
            for node, edits in states:
                if node in whole and kind != STEM and (edits == 0 or node in long):
                    kind = WORD if not edits else (kind if kind in (WORD, NEAR_STEM) else NEAR)
            self.kind.append(kind)
            if kind != STEM:  # a stem found exactly needs no more bytes
                for c in [*alphabet, other]:
                    to = step(states, c)
                    if to not in known:
                        known[to] = len(known)
                        todo.append(to)
                    row[c] = known[to]
                rest = np.ones(256, bool)
                rest[alphabet] = False
                row[rest] = row[other]
            table.append(row)
        self.table, self.kind = np.stack(table), np.array(self.kind, np.int8)

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kind of hit of each word."""
        found = np.zeros(len(starts), np.int8)
        idx, at, end = np.arange(len(starts)), starts, ends
        state = np.ones(len(starts), np.int32)
        near = np.zeros(len(starts), bool)
        while len(idx):
            state = self.table[state, data[at]]
            at = at + 1
            kind = self.kind[state]
            near[idx[kind == NEAR_STEM]] = True
            over = (at == end) | (kind == STEM) | (state == 0)
            final = over & (kind != NONE) & (state != 0)
            found[idx[final]] = kind[final]
            go = ~over
            idx, at, end, state = idx[go], at[go], end[go], state[go]
        found[(found == NONE) & near] = NEAR_STEM
        return found


def block_features(automaton: Automaton, reporting: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FEATURES of each document of a block."""
    data, opening, closing = quotation_marks(tk.LOWER[data], offs)
    starts, ends, bounds = tk.words(data, offs, tk.NOT_ALNUM)
    kind = automaton.match(data, starts, ends)
    hit = np.flatnonzero(kind)
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    doc = np.searchsorted(bounds, hit, side="right") - 1
    if len(hit):
        first, last = np.maximum(hit - WINDOW, bounds[doc]), np.minimum(hit + WINDOW, bounds[doc + 1] - 1)
        # The nearest mark before opens a quotation, the nearest after closes one, both within the window.
        from_byte = np.where(first > bounds[doc], ends[np.maximum(first - 1, 0)], offs[doc])
        to_byte = np.where(last < bounds[doc + 1] - 1, starts[np.minimum(last + 1, len(starts) - 1)], offs[doc + 1])
        opened, closed = last_before(opening, starts[hit]), last_before(closing, starts[hit])
        opens, closes = first_after(opening, ends[hit]), first_after(closing, ends[hit])
        quoted = (opened >= from_byte) & (opened > closed) & (closes < to_byte) & (closes < opens)
        short = np.flatnonzero(ends - starts <= 10)
        reports = short[np.isin(tk.span_hash(data, starts[short], ends[short]), reporting)]
        reported = np.searchsorted(reports, last, side="right") > np.searchsorted(reports, first)
        weight = np.where(quoted, QUOTED, 1.0) * np.where(reported, REPORTED, 1.0)
        # Misspelled hits count like exact ones: terms whose neighbours are common words have none.
        out[:, 0] = np.bincount(doc, weight, minlength=n)
        of = (kind[hit] == STEM) | (kind[hit] == NEAR_STEM)
        out[:, 1] = np.bincount(doc[of], weight[of], minlength=n)
        total = np.r_[0, np.cumsum(weight)]
        np.maximum.at(out[:, 2], doc, total[np.searchsorted(hit, last, side="right")] - total[:-1])
        out[:, 3] = out[:, 0] / np.maximum(np.diff(bounds), 1)
        for j, of in enumerate((kind[hit] == NEAR, kind[hit] == NEAR_STEM, quoted, reported), 4):
            out[:, j] = np.bincount(doc[of], minlength=n)
    out[:, :3] = np.log1p(out[:, :3])
    out[:, 3] = np.sqrt(out[:, 3])
    return out


def last_before(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last place before each position; -1 without one."""
    return np.r_[-1, places][np.searchsorted(places, at)]


def first_after(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place at or after each position; a large number without one."""
    return np.r_[places, 1 << 62][np.searchsorted(places, at)]


def quotation_marks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block with wide marks blanked, and where marks open (before a word, not after one) and close (after a word or a stop, not before a word)."""
    narrow = np.flatnonzero((data == 34) | (data == 39))
    found = [(narrow, narrow + 1)]
    if len(data) and (data >= 128).any():
        spans = np.array([m.span() for m in _MARK.finditer(data.tobytes())], np.int64).reshape(-1, 2)
        found.append((spans[:, 0], spans[:, 1]))
    lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(lo)
    lo, hi = lo[order], hi[order]
    data = data.copy()
    for i in range(3):
        at = lo + i
        data[at[(at < hi) & (hi - lo > 1)]] = 32
    letter = np.r_[~tk.NOT_ALNUM[data], False]
    doc = np.searchsorted(offs, lo, side="right") - 1
    before = (lo > offs[doc]) & letter[lo - 1]
    stop = (lo > offs[doc]) & ~tk.SPACE[data[lo - 1]] if len(lo) else before
    after = (hi < offs[doc + 1]) & letter[hi]
    return data, lo[after & ~before], lo[stop & ~after]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights, the last one the bias, by Newton steps."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit_positive(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of which none but the bias is negative: columns that would get one are left out, the most negative first."""
    use = np.arange(x.shape[1])
    while True:
        w = fit_logistic(x[:, use], y)
        if not len(use) or w[:-1].min() >= 0:
            break
        use = np.delete(use, w[:-1].argmin())
    out = np.zeros(x.shape[1] + 1)
    out[use], out[-1] = w[:-1], w[-1]
    return out


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether at most one byte is put in, left out or changed."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def exact_only(sums: DataFrame, terms: list[tuple[str, bool]]) -> frozenset[tuple[str, bool]]:
    """Terms whose misspelled forms stand in other documents of the sample too often. sums: (term, stem, toxic, other)."""
    automaton = Automaton(terms)

    def step(batches):
        for batch in batches:
            words = [w.encode() for w in batch.column("term").to_pylist()]
            edge = np.cumsum([0] + [len(w) for w in words])
            kind = automaton.match(np.frombuffer(b"".join(words), np.uint8), edge[:-1], edge[1:]) if words else np.zeros(0, np.int8)
            yield batch.filter(pa.array((kind == NEAR) | (kind == NEAR_STEM)))

    rows = sums.filter("NOT stem").select("term", "toxic", "other").mapInArrow(tk.lean(step), "term string, toxic long, other long").collect()
    seen = {t: [0, 0] for t in terms}
    for r in rows:
        word = r["term"].encode()
        for term, stem in terms:
            raw = term.encode()
            if one_edit(word, raw) or stem and any(one_edit(word[:n], raw) for n in (len(raw) - 1, len(raw), len(raw) + 1)):
                seen[term, stem][0] += r["toxic"]
                seen[term, stem][1] += r["other"]
    return frozenset(t for t, (toxic, other) in seen.items() if toxic < PRECISION * (toxic + other))


def learn_lexicon(docs: DataFrame, sample: DataFrame, most: int) -> tuple[list[tuple[str, bool]], frozenset[tuple[str, bool]]]:
    """Terms, and which of them only match exactly. docs: doc_id, text; sample: doc_id, label, small."""
    counts = docs.join(F.broadcast(sample), "doc_id").select("text", "label").mapInArrow(tk.lean(terms_of), "term string, stem boolean, label int, n long, bits long")
    toxic = F.col("label") == 1
    sums = counts.groupBy("term", "stem").agg(
        F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("other"), F.bit_or(F.when(toxic, F.col("bits")).otherwise(0)).alias("bits")
    )
    sums = sums.select("term", "stem", "toxic", "other", F.bit_count("bits").alias("befores"))
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return [], frozenset()
    # How much rarer a term is outside, at equal numbers of documents on both sides.
    scale = totals[1] / totals[0]
    sums = materialize(sums, "term-sums")
    best = sums.filter((F.col("toxic") >= LEAST_DOCS) & (F.col("befores") >= LEAST_DOCS - 1) & (F.col("toxic") >= PRECISION * (F.col("toxic") + scale * F.col("other"))))
    rows = best.orderBy(F.desc("toxic"), "term", "stem").limit(20 * most).collect()
    chance = totals[1] / (totals[1] + totals[0])
    rows = [(r["term"], r["stem"], r["toxic"], r["other"]) for r in rows if r["toxic"] * math.log(1 / chance) > 12 + 3 * r["other"]]
    terms = choose_terms(rows, most)
    exact = exact_only(sums, terms) if terms else frozenset()
    discard(sums)
    return terms, exact


class Toxicity:
    """Automaton and weights; no weights without labels of both kinds."""

    def __init__(self, terms: list[tuple[str, bool]], exact: frozenset[tuple[str, bool]] = frozenset()):
        self.automaton, self.weights = Automaton(terms, exact), None
        said = [w.encode() for w in REPORTING]
        edge = np.cumsum([0] + [len(w) for w in said])
        self.reporting = tk.span_hash(np.frombuffer(b"".join(said), np.uint8), edge[:-1], edge[1:])

    def features(self, text: pa.Array) -> np.ndarray:
        parts = [block_features(self.automaton, self.reporting, data, offs) for _, _, data, offs in tk.blocks(text, 1 << 20)]
        return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x[:, :FITTED] @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Lexicon and weights from at most ``sample`` labelled rows."""
    known = materialize(learning_sample(labels, "toxic", sample, id_col), "toxic-sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One row for each id of the sample, which bounds what the driver gets.
    once = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("row"))
    rows = materialize(once.select("doc_id", "row.text", "row.label"), "toxic-rows")
    model = Toxicity(*learn_lexicon(rows.select("doc_id", "text"), known, terms))

    def step(batches):
        for batch in batches:
            x = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c) for c in x.T)], names=["label", *FEATURES])

    fit = rows.select("label", "text").mapInArrow(tk.lean(step), ", ".join(["label int", *(f"{n} double" for n in FEATURES)])).toPandas()
    fit = fit.sort_values(["label", *FEATURES], ignore_index=True)
    if fit["label"].nunique() == 2:
        model.weights = fit_positive(fit[list(FEATURES[:FITTED])].to_numpy(float), fit["label"].to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, score, FEATURES) for each row."""
    model = learn_toxicity(docs, labels, id_col=id_col, text_col=text_col, **how)

    def step(batches):
        for batch in batches:
            x = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x)), *(pa.array(c) for c in x.T)], names=["doc_id", "score", *FEATURES])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType().add("doc_id", rows.schema["doc_id"].dataType).add("score", "double")
    for name in FEATURES:
        schema = schema.add(name, "double")
    return rows.mapInArrow(tk.lean(step), schema).select("doc_id", held_out().alias("held_out"), "score", *FEATURES)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that score under ``least``, as they are; scored and filtered in one pass, without a shuffle."""
    model = learn_toxicity(docs, labels, id_col=id_col, text_col=text_col, **how)

    def step(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(model.features(batch.column(text_col))) < least))

    return docs.mapInArrow(tk.lean(step), T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
