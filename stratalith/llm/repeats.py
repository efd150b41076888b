"""The steps around anchors.py that find repeated runs in all texts and cut them out.

1. ``find``: each part of the input sends its anchors to their buckets; there, occurrences with equal
   contexts are settled, and one occurrence of each further context is listed for a closer look.
2. ``look``: the listed contexts are read from their texts and sent to the anchor's bucket, where
   ``settle`` (of the operator) tells which runs through an anchor are repeats.
3. ``cut``: each text meets its settled anchors and runs, and the symbols they cover are removed.

Everything is keyed by hash buckets whose number grows with the input, so a bucket's arrays stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import anchors as an
from . import textkernel as tk
from .anchors import Runs
from .common import materialize, packed_buckets, partitions_for, text_bytes

ANCHOR_PART = "bucket int, settled boolean, a binary, c binary, id binary, tie binary, pos binary"
SPOT_PART = "bucket int, kind int, a binary, id binary, tie binary, pos binary, stop binary"
CONTEXT_PART = "bucket int, a binary, id binary, tie binary, pos binary, sides binary, context binary"
SETTLED, CLOSER, RUN, TEXT = 1, 2, 3, 9
U = np.uint64


def arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def read(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    """All parts of a packed column, one after another."""
    found = [np.frombuffer(x, kind) for x in batch.column(name).to_pylist() if x]
    return np.concatenate(found) if found else np.zeros(0, kind)


def cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, end) of each run of equal keys."""
    edge = np.flatnonzero(np.diff(sorted_keys)) + 1
    for lo, hi in zip(np.r_[0, edge], np.r_[edge, len(sorted_keys)], strict=True):
        if hi > lo:
            yield int(sorted_keys[lo]), int(lo), int(hi)


def sent(schema: str, bucket: np.ndarray, columns: dict[str, np.ndarray], **fixed) -> pa.RecordBatch | None:
    """Rows of packed parts, one for each bucket."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    columns = {k: v[order] for k, v in columns.items()}
    out: dict[str, list] = {f.name: [] for f in arrow(schema)}
    for key, lo, hi in cuts(bucket[order]):
        out["bucket"].append(key)
        for name in out:
            if name in columns:
                out[name].append(columns[name][lo:hi].tobytes())
            elif name != "bucket":
                out[name].append(fixed.get(name))
    return pa.RecordBatch.from_pydict(out, schema=arrow(schema))


def find_anchors(runs: Runs, buckets: int) -> Callable:
    """Parts of the input to anchors by bucket. Equal (anchor, context) pairs of a batch are met here."""

    def step(batches):
        for batch in batches:
            ids, ties = batch.column("id").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
            # Rows alike in id and text are one document.
            order = np.lexsort((ties, ids))
            once = np.zeros(len(ids), bool)
            once[order] = an.first_of_groups(ids[order], ties[order])
            if not once.all():
                batch, ids, ties = batch.filter(pa.array(once)), ids[once], ties[once]
            found = []
            for lo, _, data, offs in tk.blocks(batch.column("text"), 1 << 20):
                sym, bounds = an.symbols(runs, data, offs)
                a, c, doc, pos = an.find(runs, sym, bounds)
                found.append((a, c, doc + lo, pos.astype(np.uint32)))
            if not found:
                continue
            a, c, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((ties, ids))] = np.arange(len(ids))
            order = np.argsort(rank[doc], kind="stable")
            a, c, doc, pos = a[order], c[order], doc[order], pos[order]
            order = np.argsort(a ^ (c * U(0x9E3779B97F4A7C15)), kind="stable")
            a, c, doc, pos = a[order], c[order], doc[order], pos[order]
            first = an.first_of_groups(a, c)
            # One that repeats an earlier of this batch is settled. Unless first ones stay, the first is settled with it.
            again = ~first
            if not runs.keep_first:
                again[:-1] |= ~first[1:]
            for mask, settled in ((first, False), (again, True)):
                cols = {"id": ids[doc[mask]], "tie": ties[doc[mask]], "pos": pos[mask]}
                if not settled:
                    cols |= {"a": a[mask], "c": c[mask]}
                out = sent(ANCHOR_PART, (a[mask] % U(buckets)).astype(np.int64), cols, settled=settled)
                if out is not None:
                    yield out

    return tk.lean(step)


def compare_anchors(runs: Runs, doc_buckets: int) -> Callable:
    """Buckets of anchors to spots by document bucket: SETTLED and CLOSER."""

    def one(batch: pa.RecordBatch):
        done = batch.filter(batch.column("settled"))
        ids, ties, pos = read(done, "id", np.int64), read(done, "tie", np.int64), read(done, "pos", np.uint32)
        yield sent(SPOT_PART, an.doc_bucket_of(ids, ties, doc_buckets), {"id": ids, "tie": ties, "pos": pos}, kind=SETTLED)
        rest = batch.filter(pc.invert(batch.column("settled")))
        a, c, ids, ties, pos = (read(rest, n, k) for n, k in (("a", U), ("c", U), ("id", np.int64), ("tie", np.int64), ("pos", np.uint32)))
        order = np.argsort(a, kind="stable")
        new = an.first_of_groups(a[order])
        many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(a) else new
        keep = order[many]
        a, c, ids, ties, pos = a[keep], c[keep], ids[keep], ties[keep], pos[keep]
        order = np.lexsort((pos, ties, ids, c, a))
        order = order[an.first_of_groups(a[order], c[order], ids[order], ties[order], pos[order])]
        a, c, ids, ties, pos = a[order], c[order], ids[order], ties[order], pos[order]
        first = an.first_of_groups(a, c)
        again = ~first
        if not runs.keep_first:
            again[:-1] |= ~first[1:]
        group = np.cumsum(an.first_of_groups(a)) - 1
        several = (np.bincount(group, weights=first) > 1)[group] if len(a) else first
        for mask, kind in ((again, SETTLED), (first & several, CLOSER)):
            cols = {"id": ids[mask], "tie": ties[mask], "pos": pos[mask]} | ({"a": a[mask]} if kind == CLOSER else {})
            yield sent(SPOT_PART, an.doc_bucket_of(ids[mask], ties[mask], doc_buckets), cols, kind=kind)

    return by_bucket(one)


def by_bucket(one: Callable) -> Callable:
    """Apply ``one`` to the whole of each bucket of a partition that is sorted by bucket."""

    def step(batches):
        held: list[pa.RecordBatch] = []

        def whole():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for out in one(table.to_batches()[0]):
                if out is not None:
                    yield out

        for batch in batches:
            for key, lo, hi in cuts(batch.column("bucket").to_numpy()):
                if held and held[-1].column("bucket")[0].as_py() != key:
                    yield from whole()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from whole()

    return tk.lean(step)


def by_document(one: Callable, schema: pa.Schema) -> Callable:
    """Apply ``one`` to slices of text rows and the spots of their bucket, which come before them."""

    def step(batches):
        bucket, parts, spots = None, [], None
        for batch in batches:
            keys = batch.column("bucket").to_numpy().astype(np.int64) * 2 + (batch.column("kind").to_numpy() == TEXT)
            for key, lo, hi in cuts(keys):
                piece = batch.slice(lo, hi - lo)
                if key // 2 != bucket:
                    bucket, parts, spots = key // 2, [], None
                if key % 2 == 0:
                    parts.append(piece)
                    continue
                if spots is None:
                    spots = index(parts)
                    parts = []
                for out in one(piece, spots):
                    if out is not None and out.num_rows:
                        yield out

    return tk.lean(step)


def index(parts: list[pa.RecordBatch]) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    """Spots by (id, tie)."""
    if not parts:
        return {}
    kind = np.concatenate([np.repeat(np.int8(k), len(x or b"") // 8) for p in parts for k, x in zip(p.column("kind").to_pylist(), p.column("ids").to_pylist(), strict=True)])
    cols = {"kind": kind}
    for name, column, t in (("id", "ids", np.int64), ("tie", "ties", np.int64), ("pos", "pos", np.uint32)):
        cols[name] = np.concatenate([read(p, column, t) for p in parts])
    # Hashes only with CLOSER, ends only with RUN.
    for name, t, of in (("a", U, CLOSER), ("stop", np.uint32, RUN)):
        wide = np.zeros(len(kind), t)
        wide[kind == of] = np.concatenate([read(p, name, t) for p in parts])
        cols[name] = wide
    order = np.lexsort((cols["tie"], cols["id"]))
    cols = {k: v[order] for k, v in cols.items()}
    new = np.flatnonzero(an.first_of_groups(cols["id"], cols["tie"]))
    return {(int(cols["id"][lo]), int(cols["tie"][lo])): {k: v[lo:hi] for k, v in cols.items()} for lo, hi in zip(new, np.r_[new[1:], len(kind)], strict=True)}


def read_contexts(runs: Runs, buckets: int) -> Callable:
    """Texts with CLOSER spots to contexts by anchor bucket."""
    side = runs.length - runs.gram
    kind = np.uint8 if runs.unit == "byte" else U

    def flush(held):
        a, ids, ties, pos, sides, context = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return sent(CONTEXT_PART, (a % U(buckets)).astype(np.int64), {"a": a, "id": ids, "tie": ties, "pos": pos, "sides": sides, "context": context})

    def one(piece: pa.RecordBatch, spots):
        ids, ties, text = piece.column("id").to_pylist(), piece.column("tie").to_pylist(), piece.column("text")
        held, count = [], 0
        for i, key in enumerate(zip(ids, ties, strict=True)):
            at = spots.get(key)
            if at is None:
                continue
            data = np.frombuffer((text[i].as_py() or "").encode(), np.uint8)
            if runs.unit == "byte":
                sym = data
            else:
                starts, ends, _ = tk.words(data, np.array([0, len(data)]))
                sym = tk.span_hash(data, starts, ends)
            pos = at["pos"].astype(np.int64)
            padded = np.zeros(len(sym) + 2 * side, kind)
            padded[side : side + len(sym)] = sym
            context = np.lib.stride_tricks.sliding_window_view(padded, side * 2 + runs.gram)[pos]
            sides = np.stack([np.minimum(pos, side), np.minimum(len(sym) - pos - runs.gram, side)], 1).astype(np.uint16)
            held.append((at["a"], np.full(len(pos), key[0], np.int64), np.full(len(pos), key[1], np.int64), at["pos"], sides, context))
            count += len(pos)
            if count > 50_000:
                yield flush(held)
                count = 0
        if held:
            yield flush(held)

    return by_document(one, arrow(CONTEXT_PART))


def settle_contexts(runs: Runs, settle: Callable, doc_buckets: int) -> Callable:
    """Contexts of a bucket to RUN spots: starts and ends of repeated runs, in symbols of the text."""
    side = runs.length - runs.gram
    width = side * 2 + runs.gram
    kind = np.uint8 if runs.unit == "byte" else U

    def one(batch: pa.RecordBatch):
        a, ids, ties, pos = (read(batch, n, k) for n, k in (("a", U), ("id", np.int64), ("tie", np.int64), ("pos", np.uint32)))
        sides = read(batch, "sides", np.uint16).reshape(-1, 2).astype(np.int64)
        context = read(batch, "context", kind).reshape(-1, width)
        order = np.lexsort((a, pos, ties, ids))
        order = order[an.first_of_groups(a[order], pos[order], ties[order], ids[order])]
        a, ids, ties, pos, sides, context = a[order], ids[order], ties[order], pos[order], sides[order], context[order]
        # marked[i, o]: the run that begins o symbols before anchor i is a repeat.
        marked = settle(runs, a, context, sides)
        edge = np.zeros((len(a), side + 3), np.int8)
        edge[:, 1:-1] = marked
        turn = np.diff(edge, axis=1)
        row, low = np.nonzero(turn == 1)
        _, high = np.nonzero(turn == -1)
        start = pos[row].astype(np.int64) - (high - 1)
        stop = pos[row].astype(np.int64) - low + runs.length
        yield sent(SPOT_PART, an.doc_bucket_of(ids[row], ties[row], doc_buckets), {"id": ids[row], "tie": ties[row], "pos": start.astype(np.uint32), "stop": stop.astype(np.uint32)}, kind=RUN)

    return by_bucket(one)


def whole_characters(raw: bytes, gone: np.ndarray) -> np.ndarray:
    """Bytes that are gone, with the other bytes of their characters."""
    start = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.repeat(np.maximum.reduceat(gone, start), np.diff(np.r_[start, len(raw)])) if len(raw) else gone


def cut_texts(runs: Runs, rest_type: pa.DataType, characters: bool) -> Callable:
    """Texts and their SETTLED and RUN spots to kept texts."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("rest", rest_type)])
    none = np.zeros((0, 2), np.int64)

    def removed(at, n):
        edge = np.zeros(n + 1, np.int64)
        pos, run = at["pos"].astype(np.int64), at["kind"] == RUN
        lo, hi = an.reach(runs, pos[~run], n)
        lo, hi = np.r_[lo, pos[run]], np.r_[hi, at["stop"][run].astype(np.int64)]
        ok = hi > lo
        np.add.at(edge, lo[ok], 1)
        np.add.at(edge, hi[ok], -1)
        gone = np.cumsum(edge[:-1]) > 0
        turn = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        return gone, turn.reshape(-1, 2)

    def one(piece: pa.RecordBatch, spots):
        text, held, size, first = piece.column("text"), [], 0, 0
        ids, ties, rest = piece.column("id"), piece.column("tie").to_pylist(), piece.column("rest")
        keys = ids.to_pylist()

        def flush(first, end):
            n, gone, spans, kept = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.tolist() for x in spans], schema.field("spans").type), pa.array(kept, pa.binary()), rest.slice(first, end - first)], schema=schema)

        for i in range(len(piece)):
            raw = (text[i].as_py() or "").encode()
            at = spots.get((keys[i], ties[i]))
            if runs.unit == "byte":
                n, spans, kept = len(raw), none, raw
                if at is not None:
                    gone, spans = removed(at, n)
                    if characters:
                        gone = whole_characters(raw, gone)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                w = raw.split()
                n, spans = len(w), none
                if at is not None:
                    gone, spans = removed(at, n)
                    w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                kept = b" ".join(w)
            held.append((n, int((spans[:, 1] - spans[:, 0]).sum()), spans, kept))
            size += len(kept)
            if size > 8 << 20:
                yield flush(first, i + 1)
                first, size = i + 1, 0
        if held:
            yield flush(first, len(piece))

    return by_document(one, schema)


def cut_repeats(docs: DataFrame, runs: Runs, settle: Callable, *, id_col: str, text_col: str, characters: bool = False) -> DataFrame:
    """(id, n, n_removed, spans, kept, rest): each row of ``docs`` without the symbols of repeated runs.

    spans: [start, end) of removed symbols, merged; kept: what is left, as bytes; rest: the other columns.
    characters: a character that loses a byte goes whole (from ``kept``; counts and spans stay those of the bytes).
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    # An anchor for about every (length - gram + 2) / 2 symbols, of 32 bytes; a word has about 6 bytes.
    apart = (runs.length - runs.gram + 2) / 2 * (1 if runs.unit == "byte" else 6)
    buckets = packed_buckets(int(total / apart * 32))
    texts = packed_buckets(total)
    few = partitions_for(spark, buckets)
    keyed = docs.select(*an.row_id(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = keyed.mapInArrow(find_anchors(runs, buckets), ANCHOR_PART)
    spots = materialize(an.meet(parts, few).mapInArrow(compare_anchors(runs, texts), SPOT_PART), "anchor-spots")

    def met(spots: DataFrame, full: bool) -> DataFrame:
        other = [F.col(c) for c in docs.columns if c != text_col]
        rest = F.struct(*other) if full else F.lit(None).cast("boolean")
        # Packed spots are in ``ids`` and ``ties``, those of a text row in ``id`` and ``tie``.
        rows = docs.select(*an.row_id(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest.alias("rest"))
        rows = rows.select(an.doc_bucket(texts), F.lit(TEXT).alias("kind"), "id", "tie", "text", "rest")
        spots = spots.withColumnsRenamed({"id": "ids", "tie": "ties"})
        both = rows.unionByName(spots, allowMissingColumns=True)
        return an.meet(both, partitions_for(spark, texts), "kind")

    contexts = met(spots.filter(F.col("kind") == CLOSER), False).mapInArrow(read_contexts(runs, buckets), CONTEXT_PART)
    found = materialize(an.meet(contexts, few).mapInArrow(settle_contexts(runs, settle, texts), SPOT_PART), "repeat-runs")
    final = met(spots.filter(F.col("kind") == SETTLED).unionByName(found), True)
    rest_type = final.schema["rest"].dataType
    out = T.StructType.fromDDL("id long, n long, n_removed long, spans array<array<long>>, kept binary").add("rest", rest_type)
    return final.mapInArrow(cut_texts(runs, to_arrow_type(rest_type), characters), out)
