"""Suffix-array dedup by threshold-bounded interval expansion.

Each byte covered by a 100-byte string that also starts earlier (smaller doc_id, or same document, earlier
start) is removed. A suffix array of all texts would have to sort every suffix of them; as only strings of
100 bytes matter, and each of these holds a winnowed anchor, only the suffixes that begin at an anchor with
several contexts are sorted, in buckets of the anchor (a sparse suffix array). From there:

* backward extension: one LF step (a stable sort by the byte before each suffix, the column of the
  Burrows-Wheeler transform) turns the order of suffixes that begin o bytes before the anchors into that at o + 1;
* common prefixes are derived by it, by increasing value: two neighbours after a step share one byte more than the least
  common prefix between their places before it, or nothing where the bytes differ. No string is compared again;
* breadth first and bounded: a step extends all intervals at once. An interval is a run of suffixes whose common prefixes
  can still reach the minimum length in the steps left (28 bytes at the anchor, one more with each step); what stands alone in
  its interval is dropped, and steps stop at the minimum length;
* suffixes that share 100 bytes or more are one repeated string: all but its first occurrence are marked.

Bytes are compared for the first order only. Anchors with one context need no interval: equal context hashes
(64 bits each for anchor and context) settle them.

Defined results: a null text is empty; a text of fewer than 100 bytes loses none; rows with one doc_id and
different texts are different documents, in order of a hash of the text; rows alike in both are one document,
given back as often as it came; a null doc_id comes first; an empty table gives an empty table. Ids are integers, others
raise a TypeError; a text of more than 2^28 bytes raises a ValueError. Input columns named as an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Runs
from .repeats import cut_repeats

RUNS = Runs(length=100, gram=28, unit="byte", keep_first=True)


def suffix_order(strings: np.ndarray) -> np.ndarray:
    """Rows of a byte matrix in order."""
    m, width = strings.shape
    wide = np.zeros((m, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort(words.T[::-1])


def common_prefixes(strings: np.ndarray) -> np.ndarray:
    """How many bytes each row of an ordered matrix shares with the one before it; 0 for the first."""
    if not len(strings):
        return np.zeros(0, np.int64)
    other = strings[1:] != strings[:-1]
    return np.r_[0, np.where(other.any(axis=1), other.argmax(axis=1), strings.shape[1])]


def least_between(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """min(values[after + 1 .. to]) for each pair of places."""
    if not len(after):
        return np.zeros(0, values.dtype)
    edges = np.stack([after + 1, to + 1], 1).ravel()
    return np.minimum.reduceat(np.r_[values, values.max()], edges)[::2]


def expand_intervals(runs: Runs, anchor: np.ndarray, context: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """[i, o]: whether the string from o bytes before anchor i has an earlier occurrence; rows come in text order."""
    side, length, m = runs.length - runs.gram, runs.length, len(anchor)
    marked = np.zeros((m, side + 1), bool)
    order = suffix_order(context[:, side : side + length])
    shared = common_prefixes(context[order, side : side + length])
    for o in range(side + 1):
        interval = np.cumsum(np.r_[True, shared[1:] < length - side + o]) - 1 if len(order) else order
        several = (np.bincount(interval) > 1)[interval] if len(order) else np.zeros(0, bool)
        order, shared, interval = order[several], shared[several], interval[several]
        if not len(order):
            break
        whole = (sides[order, 0] >= o) & (sides[order, 1] >= side - o)
        new = np.r_[True, shared[1:] < length]
        new[1:] |= interval[1:] != interval[:-1]
        first = np.minimum.reduceat(np.where(whole, order, m), np.flatnonzero(new))
        marked[order[whole & (first[np.cumsum(new) - 1] != order)], o] = True
        if o < side:
            at = np.flatnonzero(sides[order, 0] > o)
            byte = context[order[at], side - o - 1]
            at = at[np.lexsort((at, byte, interval[at]))]
            byte, of = context[order[at], side - o - 1], interval[at]
            same = np.flatnonzero((byte[1:] == byte[:-1]) & (of[1:] == of[:-1]))
            longer = np.zeros(len(at), np.int64)
            longer[same + 1] = 1 + least_between(shared, at[same], at[same + 1])
            order, shared = order[at], longer
    return marked


def remove_repeated_bytes(docs: DataFrame, *, length: int = RUNS.length, gram: int = RUNS.gram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, with ``kept`` (bytes), n_bytes, n_removed and spans ([start, end) in bytes)."""
    out = cut_repeats(docs, Runs(length, gram, "byte", True), expand_intervals, id_col=id_col, text_col=text_col)
    rest = [F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in (text_col, "kept", "n_bytes", "n_removed", "spans")]
    return out.select(*rest, "kept", F.col("n").alias("n_bytes"), "n_removed", "spans")


def cut_repeated_text(docs: DataFrame, *, length: int = RUNS.length, gram: int = RUNS.gram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later occurrences of ``length`` bytes cut from the text; a character that loses a byte goes whole, no other does. A null text becomes an empty one; columns may have any names."""
    out = cut_repeats(docs, Runs(length, gram, "byte", True), expand_intervals, id_col=id_col, text_col=text_col, characters=True)
    return out.select(*(F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op6_remove_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# Bytes as two hex digits each: a string is 200 digits at an odd place.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE r > 1),
far AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM dup),
grp AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM far),
span AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM grp GROUP BY doc_id, g),
edge AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_ FROM span),
sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM span GROUP BY doc_id),
kept AS (SELECT edge.doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (lo - from_)), '' ORDER BY lo) AS k FROM edge JOIN d ON d.doc_id = edge.doc_id GROUP BY edge.doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN x ELSE coalesce(k, '') || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

QUERIES = {"op6_remove_repeated_bytes": op6_remove_repeated_bytes}
ORACLE_SQL = {"op6_remove_repeated_bytes": SQL}
