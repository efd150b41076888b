"""Winnowed anchors: where texts may share a run of ``length`` symbols (words or bytes).

Among the ``gram``-symbol grams of each run of ``length`` symbols the one with the least hash is an
anchor, so two equal runs hold the same anchor at the same place. An anchor's context is all that a run
holding it can reach: length - gram symbols on either side, less where the text ends.

Three steps share one layout. Parts are packed arrays keyed by a bucket of the anchor's hash. Within a
part equal (anchor, context) pairs are met once (``local``), so an anchor that a third of all rows hold
reaches its bucket once for each part. In a bucket, occurrences with equal contexts are settled at once: all
runs through them are repeats. Only one occurrence for each further context of an anchor is looked at closer.

A row is told by (id, tie): its id and a 64-bit hash of its text. A null id is the least one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk

U = np.uint64
LOW28 = U((1 << 28) - 1)
NULL_ID = -(1 << 63)
BYTE_SYMBOL = tk.mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_B = U(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


class Runs(NamedTuple):
    """length: symbols of a run; gram: symbols of an anchor; unit: ``word`` or ``byte``; keep_first: only later occurrences are repeats."""

    length: int
    gram: int
    unit: str
    keep_first: bool


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(int(_B), -1, 1 << 64)
        up = np.full(size, _B, U)
        down = np.full(size, U(inverse), U)
        up[0] = down[0] = U(1)
        _powers[:] = [np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)]
    return _powers[0], _powers[1]


def symbols(runs: Runs, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit symbol for each word or byte, and the bounds of documents among them."""
    if runs.unit == "byte":
        return BYTE_SYMBOL[data], offs
    starts, ends, bounds = tk.words(data, offs)
    return tk.span_hash(data, starts, ends), bounds


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, width = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n])


def find(runs: Runs, sym: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block: hash, hash of the context, document number, position in the document."""
    k, length = runs.gram, runs.length
    if len(sym) > 1 << 28:
        raise ValueError("a text of more than 2 ** 28 symbols")
    full = tk.windows_ok(bounds, length)
    none = np.zeros(0, U)
    if not full.any():
        return none, none, none.astype(np.int64), none.astype(np.int64)
    g = tk.gram_hash(sym, k)
    key = (g & ~LOW28) | (LOW28 - (np.arange(len(g), dtype=U) & LOW28))
    least = sliding_min(key, length - k + 1)[full]
    at = np.zeros(len(g), bool)
    at[(LOW28 - (least & LOW28)).astype(np.int64)] = True
    pos = np.flatnonzero(at)
    doc = np.searchsorted(bounds, pos, side="right") - 1
    lo = np.maximum(bounds[doc], pos + k - length)
    hi = np.minimum(bounds[doc + 1], pos + length)
    up, down = powers(len(sym) + 1)
    sums = np.zeros(len(sym) + 1, U)
    np.cumsum(sym * up[: len(sym)], out=sums[1:])
    context = (sums[hi] - sums[lo]) * down[lo]
    context = tk.mix(context ^ ((pos - lo).astype(U) << U(32)) ^ (hi - pos).astype(U))
    return g[pos], context, doc, pos - bounds[doc]


def reach(runs: Runs, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all runs through an anchor at ``pos`` of a text of ``size`` symbols."""
    lo = np.maximum(0, pos + runs.gram - runs.length)
    return lo, np.minimum(pos, size - runs.length) + runs.length


def first_of_groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins, for keys in sorted order."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def pack(**arrays: np.ndarray) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}


def row_id(docs: DataFrame, id_col: str, text_col: str):
    """(id, tie) of a row as columns."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column: earlier documents have smaller ids")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tie")


def doc_bucket(buckets: int):
    return F.pmod(F.pmod(F.col("id"), F.lit(buckets)) + F.pmod(F.col("tie"), F.lit(buckets)), F.lit(buckets)).cast("int").alias("bucket")


def doc_bucket_of(ids: np.ndarray, ties: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids % buckets + ties % buckets) % buckets).astype(np.int64)


def meet(parts: DataFrame, partitions: int, *order: str) -> DataFrame:
    """Rows of a bucket in one partition, one after another."""
    return parts.repartition(partitions, "bucket").sortWithinPartitions("bucket", *order)
