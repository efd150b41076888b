"""Text statistics of whole documents, vectorised over blocks of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

U = np.uint64
COUNTS = (
    "n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_upper", "n_digits", "n_punct", "n_bangs", "n_wide", "n_bars", "longest_word", "n_same_next",
)
REPEAT = 8

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_punct = np.zeros(256, bool)
_punct[list(b".,;:!?'\"()-")] = True
_WS = b" \t\n\v\f\r"


def per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def repeated_words(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each document within 8-word windows that its text holds twice or more."""
    ok = tk.windows_ok(bounds, REPEAT)
    if not ok.any():
        return np.zeros(len(bounds) - 1, np.int64)
    doc = tk.docs_of(bounds)
    at = np.flatnonzero(ok)
    g = tk.mix(tk.gram_hash(h, REPEAT)[at] + doc[at].astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(g)
    same = g[order][1:] == g[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[:-1] |= same
    twice[1:] |= same
    return per_doc(tk.covered(len(h), at[order[twice]], REPEAT), bounds)


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_WS)]
    return len(lines), len(lines) - len(set(lines))


def block_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """COUNTS of each document of a block."""
    n = len(offs) - 1
    starts, ends, bounds = tk.words(data, offs)
    h = tk.span_hash(data, starts, ends)
    doc = tk.docs_of(bounds)
    out = np.zeros((len(COUNTS), n), np.int64)
    raw = data.tobytes()
    lines = np.array([duplicate_lines(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.int64).reshape(n, 2)
    char = (data & 0xC0) != 0x80
    own = tk.mix(h + doc.astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(own)
    fresh = np.zeros(len(own), bool)
    fresh[order] = np.r_[True, own[order][1:] != own[order][:-1]] if len(own) else fresh
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, ends - starts)
    following = np.zeros(len(h), bool)
    following[:-1] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    rows = (
        np.diff(offs), np.diff(bounds), per_doc(char & ~tk.SPACE[data], offs), per_doc(_symbol[data], offs), lines[:, 0], lines[:, 1],
        repeated_words(h, bounds), per_doc(fresh, bounds), per_doc(_upper[data], offs), per_doc(_digit[data], offs), per_doc(_punct[data], offs),
        per_doc(data == 33, offs), per_doc((data >= 128) & char, offs), per_doc(data == 124, offs), longest, per_doc(following, bounds),
    )
    for i, x in enumerate(rows):
        out[i] = x
    return out


def text_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, COUNTS) of each row; a null text is empty. Each count is a long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def step(batches):
        for batch in batches:
            parts = [block_counts(data, offs) for _, _, data, offs in tk.blocks(batch.column("text"), 1 << 20)]
            if parts:
                counts = np.concatenate(parts, axis=1)
                keep = [batch.column(c) for c in ("doc_id", *carry)]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x) for x in counts)], names=["doc_id", *carry, *COUNTS])

    schema = rows.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return rows.mapInArrow(tk.lean(step), schema)


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 5 is 0; never used to learn. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def learning_sample(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """Up to ``most`` labelled ids to learn from, the first by a hash of the id: (doc_id, label). The bound makes it safe to broadcast."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
