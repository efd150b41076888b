"""Substring dedup by seed and extend.

Seeds are winnowed anchors: grams of 14 words, one at least in each run of 35 words. Occurrences of an
anchor are joined by its bucket and extended both ways, a word at a time: those that agree on o words to
the left and on what a run of 35 then lacks to the right hold one run. Runs found twice or more anywhere,
one document included, are joined to maximal repeats and all words in them are removed, the first
occurrence too.

Words are `[^ \\x09-\\x0D]+` and compared unchanged, by 64-bit hashes within one anchor's occurrences.

Defined results: a null text is empty (no words); a text of fewer than 35 words loses none; rows with one
doc_id and different texts are different documents; rows alike in both are one document, given back as
often as it came, and no repeat of itself; a null doc_id is an id like others; an empty table gives an empty table. Ids are integers,
others raise a TypeError; a text of more than 2^28 words raises a ValueError. Input columns named as an output column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .anchors import NULL_ID, Runs
from .repeats import cut_repeats

RUNS = Runs(length=35, gram=14, unit="word", keep_first=False)
U = np.uint64
_P = U(0xD6E8FEB86659FD93)


def extend(runs: Runs, anchor: np.ndarray, context: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """[i, o]: whether the run from o words before anchor i has an equal one at another context."""
    side, m = runs.length - runs.gram, len(anchor)
    left, right = np.empty((side + 1, m), U), np.empty((side + 1, m), U)
    left[0], right[0] = anchor, tk.mix(anchor * _P)
    for o in range(side):
        left[o + 1] = tk.mix(left[o] * _P + context[:, side - 1 - o])
        right[o + 1] = tk.mix(right[o] * _P + context[:, side + runs.gram + o])
    marked = np.zeros((m, side + 1), bool)
    for o in range(side + 1):
        whole = np.flatnonzero((sides[:, 0] >= o) & (sides[:, 1] >= side - o))
        key = left[o][whole] ^ (right[side - o][whole] * _P)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        both = np.zeros(len(whole), bool)
        both[:-1] |= same
        both[1:] |= same
        marked[whole[order], o] = both
    return marked


def remove_repeats(docs: DataFrame, *, words: int = RUNS.length, gram: int = RUNS.gram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` with ``kept_text`` in place of nothing else, n_words, n_removed and spans ([start, end) in words)."""
    out = cut_repeats(docs, Runs(words, gram, "word", False), extend, id_col=id_col, text_col=text_col)
    rest = [F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in (text_col, "kept_text", "n_words", "n_removed", "spans")]
    return out.select(*rest, F.col("kept").cast("string").alias("kept_text"), F.col("n").alias("n_words"), "n_removed", "spans")


def op3_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE h IN (SELECT h FROM dup)),
gone AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT word.* FROM word ANTI JOIN pos USING (doc_id, p)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

QUERIES = {"op3_remove_repeats": op3_remove_repeats}
ORACLE_SQL = {"op3_remove_repeats": SQL}
