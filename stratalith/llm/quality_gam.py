"""Quality classifier: a generalised additive model with pairwise interactions.

Statistics of a text are cut into quantile bins. Shallow trees (up to two cuts) are boosted in turn, one
feature after another, on the logistic loss; each tree only adds to its feature's lookup table. Then the pairs
whose coarse bins explain most of what is left get tables of their own, boosted the same way. A score is the
sum of a table entry for each feature and pair: a vectorised addition of looked-up bins.

The model is fitted on at most ``sample`` labelled rows (the first by a hash of the id), never on rows whose
crc32(doc_id) mod 5 is 0. labels, lang, source and doc_id are no features.

Defined results: a null text scores as an empty one; null labels aren't used; without any label the score is
0.5; empty tables give empty tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .features import held_out, learning_sample, text_counts

SAMPLE, BINS, COARSE, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 20_000, 32, 8, 120, 0.15, 6, 40
FEATURES = {
    "log_words": "ln(1 + n_words)", "word_length": "word_chars / greatest(n_words, 1)", "symbols": "n_symbols / greatest(n_bytes, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "distinct": "n_distinct_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_bytes, 1)", "digits": "n_digits / greatest(n_bytes, 1)", "punct": "n_punct / greatest(n_bytes, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)", "wide": "n_wide / greatest(n_bytes, 1)", "bars": "n_bars / greatest(n_words, 1)",
    "longest": "ln(1 + longest_word)", "line_words": "ln(1 + n_words / greatest(n_lines, 1))", "same_next": "n_same_next / greatest(n_words, 1)",
}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def shallow_tree(grad: np.ndarray, hess: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Values by bin of the best tree with up to two cuts, from the bins' sums of gradient and Hessian."""
    g, h = np.r_[0.0, np.cumsum(grad)], np.r_[0.0, np.cumsum(hess)]
    n = len(grad)

    def gain(lo, hi):
        return (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + smooth)

    cuts = np.arange(1, n)
    if not len(cuts):
        return np.full(n, g[n] / (h[n] + smooth))
    first = int(cuts[np.argmax(gain(0, cuts) + gain(cuts, n))])
    others = cuts[cuts != first]
    edges = [0, first, n]
    if len(others):
        lo, hi = np.minimum(others, first), np.maximum(others, first)
        second = int(others[np.argmax(gain(0, lo) + gain(lo, hi) + gain(hi, n))])
        edges = sorted({0, first, second, n})
    out = np.zeros(n)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + smooth)
    return out


class Gam:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if len(y) and 0 < y.sum() < len(y):
            self.fit(self.bins(x), y)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def coarse(self, b: np.ndarray, f: int) -> np.ndarray:
        return b[:, f] * COARSE // len(self.tables[f])

    def fit(self, b: np.ndarray, y: np.ndarray) -> None:
        at = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = sigmoid(at)
                step = RATE * shallow_tree(np.bincount(b[:, f], y - p, len(table)), np.bincount(b[:, f], p * (1 - p), len(table)))
                table += step
                at += step[b[:, f]]
        p = sigmoid(at)
        gains = []
        for i, j in combinations(range(len(self.tables)), 2):
            cell = self.coarse(b, i) * COARSE + self.coarse(b, j)
            gains.append(((np.bincount(cell, y - p, COARSE**2) ** 2 / (np.bincount(cell, p * (1 - p), COARSE**2) + 1)).sum(), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros(COARSE**2) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                p, ci, cj = sigmoid(at), self.coarse(b, i), self.coarse(b, j)
                # A tree for each side of the best cut of the first feature.
                g, h = (np.bincount(ci * COARSE + cj, v, COARSE**2).reshape(COARSE, COARSE) for v in (y - p, p * (1 - p)))
                gs, hs = np.cumsum(g.sum(1)), np.cumsum(h.sum(1))
                cut = 1 + int(np.argmax(gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)))
                step = np.zeros((COARSE, COARSE))
                for side in (slice(0, cut), slice(cut, COARSE)):
                    step[side] = RATE * shallow_tree(g[side].sum(0), h[side].sum(0))
                table += step.ravel()
                at += step[ci, cj]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        at = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            at += table[b[:, f]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            at += table[self.coarse(b, i) * COARSE + self.coarse(b, j)]
        return sigmoid(at)


def score_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of each row."""
    stats = text_counts(docs, id_col=id_col, text_col=text_col).select("doc_id", *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()))
    table = materialize(stats, "gam-features")
    # One row for each id of the sample, which bounds what the driver gets.
    known = table.join(F.broadcast(learning_sample(labels, label, sample, id_col)), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "label")).alias("row")).select("doc_id", "row.*").toPandas()
    known = known.sort_values(["doc_id", *FEATURES], ignore_index=True)
    model = Gam(known[list(FEATURES)].to_numpy(float), known["label"].to_numpy(float))

    def step(batches):
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    schema = table.select("doc_id").schema.add("score", "double")
    return table.mapInArrow(step, schema).select("doc_id", held_out().alias("held_out"), "score")


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op8_quality_gam": op8_quality_gam}
ORACLE_SQL: dict[str, str] = {}
