"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are all byte 2-grams and 3-grams of the text in lower case (A-Z) with every run of other ASCII than
letters as one mark. Each is hashed to one of ``BUCKETS`` embeddings; a text is their average, and a linear
softmax over it gives the language. Embeddings and weights are trained by stochastic gradient descent in numpy on
at most ``sample`` documents (the first by a hash of the id), never on rows whose crc32(doc_id) mod 5 is 0. A fifth of
them only calibrates: a temperature for the score, and the least score to accept, the lowest at which accepted
documents of that fifth are right with ``precision``.

As the softmax is linear, embeddings and weights are multiplied once and a text's scores are sums of
looked-up rows: whole texts are read at a few nanoseconds a byte.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if nothing could be learned;
null languages are never learned; ties go to the first language in order; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .features import held_out

SAMPLE, BUCKETS, WIDTH, EPOCHS, RATE, PRECISION = 3_000, 1 << 14, 16, 12, 2.0, 0.99
GRAMS = (2, 3)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size of gram: buckets of all positions, and which positions count (within a text, no run of marks)."""
    x = _FOLD[data]
    end = np.repeat(offs[1:], np.diff(offs))
    at = np.arange(len(x))
    out = []
    for n in GRAMS:
        m = max(0, len(x) - n + 1)
        code = np.zeros(m, np.uint32)
        for i in range(n):
            code = (code << np.uint32(8)) | x[i : i + m]
        ok = (at[:m] + n <= end[:m]) & ~((x[:m] == 32) & (x[1 : m + 1] == 32)) if m else np.zeros(0, bool)
        out.append((((code * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(18)).astype(np.int64) & (BUCKETS - 1), ok))
    return out


class Model:
    """Languages, a row of scores for each bucket, bias, temperature and the least score to accept."""

    def __init__(self, langs: list[str], docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray):
        rng = np.random.default_rng(7)
        self.langs, n = langs, len(langs)
        check = np.arange(len(y)) % 5 == 4 if len(y) >= 25 else np.zeros(len(y), bool)
        train = np.flatnonzero(~check)
        embed, weights, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.3, (WIDTH, n)), np.zeros(n)
        steps = EPOCHS * max(1, len(train))
        done = 0
        for _ in range(EPOCHS):
            for i in rng.permutation(train):
                idx, share = docs[i]
                rate = RATE * (1 - done / steps)
                done += 1
                mean = share @ embed[idx]
                grad = self.softmax((mean @ weights + bias)[None])[0]
                grad[y[i]] -= 1
                back = weights @ grad
                weights -= rate * 0.1 * np.outer(mean, grad)
                bias -= rate * 0.01 * grad
                embed[idx] -= rate * share[:, None] * back
        self.rows, self.bias = (embed @ weights).astype(np.float32), bias
        self.temperature, self.least = 1.0, 0.0
        if check.any():
            held = np.flatnonzero(check)
            logits = np.stack([docs[i][1] @ self.rows[docs[i][0]] + bias for i in held])
            grid = np.geomspace(0.05, 10, 60)
            loss = [-np.log(np.maximum(self.softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            p = self.softmax(logits / self.temperature)
            top, right = p.max(1), p.argmax(1) == y[held]
            order = np.argsort(-top)
            good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
            self.least = float(top[order][good[-1]]) if len(good) else 1.0

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n, total = len(offs) - 1, np.zeros(len(offs) - 1)
        logits = np.zeros((n, len(self.langs)))
        sums = np.zeros(len(data) + 1)
        for bucket, ok in subwords(data, offs):
            at = np.flatnonzero(ok)
            edge = np.searchsorted(at, offs)
            total += np.diff(edge)
            rows = self.rows[bucket[at]]
            for j in range(len(self.langs)):
                np.cumsum(rows[:, j], dtype=np.float64, out=sums[1 : len(at) + 1])
                logits[:, j] += sums[edge[1:]] - sums[edge[:-1]]
        return self.softmax((logits / np.maximum(total, 1)[:, None] + self.bias) / self.temperature)


def sparse_counts(batches):
    """Shares of the buckets in each text, for training."""
    for batch in batches:
        ids, shares = [], []
        for _, _, data, offs in tk.blocks(batch.column("text"), 1 << 20):
            counts = subwords(data, offs)
            for lo, hi in zip(offs[:-1], offs[1:], strict=True):
                own = np.concatenate([b[lo:hi][ok[lo:hi]] for b, ok in counts])
                idx, n = np.unique(own, return_counts=True)
                ids.append(idx.astype(np.int32).tobytes())
                shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "lang", "idx", "share"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "") & ~held_out())
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = usable.filter(F.col("doc_id").isNotNull()).select("doc_id").orderBy(key, "doc_id").limit(sample).distinct()
    # One row for each id of the sample, which bounds what the driver gets.
    once = usable.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("text"), "lang")).alias("row"))
    rows = once.select("doc_id", "row.lang", "row.text").mapInArrow(sparse_counts, docs.select("doc_id").schema.add("lang", "string").add("idx", "binary").add("share", "binary")).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["lang"], r["idx"]))
    langs = sorted({r["lang"] for r in rows})
    found = [(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows]
    return Model(langs, found, np.array([langs.index(r["lang"]) for r in rows], np.int64))


def identify(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): accepted is whether the calibrated score is high enough."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), sample)
    letter = np.zeros(256, bool)
    letter[97:123] = letter[65:91] = True

    def step(batches):
        for batch in batches:
            names, scores = [], []
            for lo, _, data, offs in tk.blocks(batch.column("text"), 1 << 20):
                n = len(offs) - 1
                count = np.concatenate([[0], np.cumsum(letter[data])])
                has = count[offs[1:]] > count[offs[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode())
                if not model.langs:
                    has[:] = False
                p = model.probabilities(data, offs) if model.langs else np.zeros((n, 1))
                best = p.argmax(1)
                names += [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                scores.append(np.where(has, p.max(1), 0.0))
            if names:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(np.concatenate(scores))], names=["doc_id", "lang_pred", "score"])

    out = rows.mapInArrow(tk.lean(step), rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", ((F.col("score") >= model.least) & (F.col("lang_pred") != "und")).alias("accepted"))


def op10_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_identify": op10_identify}
ORACLE_SQL: dict[str, str] = {}
