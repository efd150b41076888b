"""N-gram Jaccard join with token-combination prefixes.

Documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more are linked; all links
count for the components, none is sampled away.

* Tokens (shingles) are ordered by rarity. Rarity comes from a count of all tokens of all documents, hashed to a
  table of fixed size, and from counts of the tokens that prefixes hold; both only steer the order and the classes, which
  are total for any values, so they can't lose a link.
* A set of n tokens must share 3/4 of them, so of its first n // 4 + 1 tokens one is shared. Tokens of the rare class
  are indexed alone. Frequent tokens are dealt to groups by hash and indexed as pairs within a group; for each group
  met, the prefix grows by one token, so two sets that share no rare token there share two of one group.
* A posting carries ``rest``, the most tokens that its set can share with another whose first common signature this
  is. A pair is looked at only where both rests reach 3/7 of the summed sizes (which is what 0.75 needs) - the positional bound.
* Members of a signature that few sets have are paired with each other. In a longer list one member, the one with the least rarer
  than the signature, is the pivot; all others are checked against it. What is then in one component needs no further check. Members outside the pivot's component meet the others by bands
  of sizes: a member is dealt to just the bands that its rest allows, so texts with enough tokens of their own meet nobody.
* A check first compares parity bits of both sets, whose distance is at most that of the sets, then counts the shared tokens of both whole sets.
* Signatures that very many sets may hold are salted: each salt has its own pivot, and the bands bring the salts together.

Nodes (distinct sets) and tokens are 64-bit hashes. Defined results: a null or wordless text has an empty set and is its own
component; fewer than five words are one token; rows that repeat a doc_id are rows of their own; a null doc_id
joins a component without naming it; an empty table gives an empty table; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors as an
from . import textkernel as tk
from .common import discard, materialize, packed_buckets, partitions_for, row_key, settings, text_bytes
from .graph import components
from .repeats import by_bucket, read, sent

U = np.uint64
SHINGLE = 5
CELL_BITS, CELL_PARTS = 23, 32
MAP_BITS = 26
#: Postings that a worker holds before it sends them, and bytes of a batch sent to a worker.
PART_POSTINGS, BATCH_BYTES = 400_000, 8 << 20
#: Tokens that more than MANY prefixes hold are listed and come last; at most so many are broadcast (9 bytes each), of more those in the most prefixes.
MANY, MOST_LISTED = 7, 1 << 21
#: From 2 ** FREQUENT sets on a token is frequent.
FREQUENT = 6
#: A signature that 2 ** level sets may hold is dealt to 2 ** (level - SALT_LEVEL) salts.
SALT_LEVEL = 12
#: Words of a set's parity bits.
SKETCH = 16
#: Bands of sizes grow by a twentieth.
BANDS = 20
#: Up to so many nodes (8 bytes each) are broadcast to thin out token sets before a check; more are met by shuffle.
SMALL_NODES = 500_000
COUNT_PART = "bucket int, token binary, count binary"
POSTING_PART = "bucket int, sig binary, node binary, n binary, rest binary, salted binary"
_K = U(0x9E3779B97F4A7C15)


def block_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each document of a block, in order, and where each document's begin."""
    data = tk.LOWER[data]
    starts, ends, bounds = tk.words(data, offs)
    h = tk.span_hash(data, starts, ends)
    at = np.flatnonzero(tk.windows_ok(bounds, SHINGLE))
    token, doc = tk.gram_hash(h, SHINGLE)[at] if len(at) else np.zeros(0, U), tk.docs_of(bounds)[at]
    count = np.diff(bounds)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        if len(short):
            token, doc = np.r_[token, tk.gram_hash(h, k)[bounds[short]]], np.r_[doc, short]
    order = np.argsort(token, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    token, doc = token[order], doc[order]
    new = an.first_of_groups(doc, token)
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(offs)))


def nodes_of(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    size = np.diff(bounds).astype(U)
    total = np.zeros((2, len(token) + 1), U)
    np.cumsum(tk.mix(token ^ _K), out=total[0, 1:])
    np.cumsum(tk.mix(token * _K), out=total[1, 1:])
    one, two = (t[bounds[1:]] - t[bounds[:-1]] for t in total)
    return tk.mix(one ^ tk.mix(two + size)).view(np.int64)


def sketches(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set SKETCH words of 64 bits; a bit tells whether an odd number of tokens fall on it."""
    out = np.zeros((len(bounds) - 1, SKETCH), np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        mixed = tk.mix(token ^ _K)
        bit, word = U(1) << (mixed & U(63)), (mixed >> U(6)) % U(SKETCH)
        for w in range(SKETCH):
            out[some, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, U(0)), bounds[:-1][some]).view(np.int64)
    return out


def sets_and_cells(batches):
    """(rid, doc_id, n, node, sketch) of each row, and the partition's token counts by cell, packed."""
    cells = np.zeros(1 << CELL_BITS, np.uint32)
    names = ["rid", "doc_id", "n", "node", "sketch", "bucket", "counts"]
    kinds = None
    for batch in batches:
        kinds = batch.column("doc_id").type
        n, node, bits = [], [], []
        for _, _, data, offs in tk.blocks(batch.column("text"), 1 << 20):
            token, bounds = block_sets(data, offs)
            n.append(np.diff(bounds))
            node.append(nodes_of(token, bounds))
            bits.append(sketches(token, bounds))
            cell, count = np.unique((token >> U(64 - CELL_BITS)).astype(np.int32), return_counts=True)
            cells[cell] += count.astype(np.uint32)
        if n:
            rows = batch.num_rows
            sketch = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * SKETCH, np.concatenate(bits).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(node)), sketch, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    if kinds is not None:
        for i, part in enumerate(np.split(cells, CELL_PARTS)):
            packed = zlib.compress(part.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kinds), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([i], pa.int32()), pa.array([packed], pa.binary())], names=names)


def add_cells(batches):
    """Binary logarithms of the summed counts, a byte for each cell, by part of the cells."""
    total, at = None, None

    def done():
        level = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["bucket", "levels"])

    for batch in batches:
        for i, packed in zip(batch.column("bucket").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if i != at and at is not None:
                yield done()
                total = None
            part = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
            at, total = i, part if total is None else total + part
    if at is not None:
        yield done()


class Classes:
    """Levels of cells, and the listed tokens (those that several prefixes hold) with theirs."""

    def __init__(self, levels: np.ndarray, noise: int, token: np.ndarray, level: np.ndarray):
        order = np.argsort(token)
        self.levels, self.noise, self.token, self.level = levels, noise, token[order], level[order]

    def of(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level of each token, whether it is listed (or its cell stands out), and whether it is frequent."""
        level = self.levels[token >> U(64 - CELL_BITS)]
        listed = level >= max(FREQUENT, self.noise + 2)
        if len(self.token):
            at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
            here = (self.token[at] == token) & ~listed
            level = np.where(here, self.level[at], level)
            listed |= here
        return level, listed, listed & (level >= FREQUENT)

    def order(self, token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each document, from rare to frequent, with levels and classes. doc: ascending."""
        level, listed, hot = self.of(token)
        at = np.argsort((listed.astype(U) << U(63)) | (level.astype(U) << U(57)) | (token >> U(7)), kind="stable")
        at = at[np.argsort(doc[at].astype(np.uint32), kind="stable")]
        return token[at], level[at], hot[at]


def ordered_sets(batch: pa.RecordBatch, classes: Classes):
    """For each block of a batch: (tokens in order, levels, frequent, where documents begin, ranks, nodes, which documents are new in the batch)."""
    known = np.zeros(0, np.int64)
    for _, _, data, offs in tk.blocks(batch.column("text"), 1 << 20):
        token, bounds = block_sets(data, offs)
        node, n = nodes_of(token, bounds), np.diff(bounds)
        _, first = np.unique(node, return_index=True)
        fresh = np.zeros(len(node), bool)
        fresh[first] = True
        fresh &= (n > 0) & ~np.isin(node, known)
        known = np.r_[known, node[fresh]]
        doc = np.repeat(np.arange(len(n)), n)
        token, level, hot = classes.order(token, doc)
        yield token, level, hot, bounds, doc, np.arange(len(token)) - bounds[:-1][doc], node, fresh


def count_prefixes(classes, buckets: int):
    """How many sets of a batch hold each unlisted token in their prefix, by bucket of the token."""

    def step(batches):
        for batch in batches:
            found = []
            for token, _, _, bounds, doc, rank, _, fresh in ordered_sets(batch, classes.value):
                found.append(token[fresh[doc] & (rank < (np.diff(bounds) // 4 + 1)[doc])])
            if found:
                token, count = np.unique(np.concatenate(found), return_counts=True)
                some = ~classes.value.of(token)[1]
                token, count = token[some], count[some]
                yield sent(COUNT_PART, (token % U(buckets)).astype(np.int64), {"token": token, "count": count.astype(np.uint32)})

    return step


def present(step):
    """Without the empty parts of a step."""

    def run(batches):
        return (x for x in step(batches) if x is not None)

    return tk.lean(run)


def add_counts(many: int):
    """Tokens that more than ``many`` prefixes hold, with the binary logarithm of the number."""

    def step(batch: pa.RecordBatch):
        token, count = read(batch, "token", U), read(batch, "count", np.uint32)
        order = np.argsort(token, kind="stable")
        token, count = token[order], count[order]
        at = np.flatnonzero(an.first_of_groups(token))
        total = np.add.reduceat(count, at, dtype=np.int64) if len(at) else count[:0]
        keep = total > many
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(token[at][keep].view(np.int64)), pa.array(np.floor(np.log2(total[keep])).astype(np.int32))], names=["token", "level"])

    return step


def listed_tokens(counts: DataFrame, classes: Classes) -> Classes:
    """Classes with the tokens counted; of more than MOST_LISTED those of the higher levels."""
    room = MOST_LISTED - len(classes.token)
    tall, least = counts.groupBy("level").count().orderBy(F.desc("level")).collect(), 1 << 30
    for r in tall:
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    rows = counts.filter(F.col("level") >= least).collect()
    token = np.array([r["token"] for r in rows], np.int64).view(U)
    return Classes(classes.levels, classes.noise, np.r_[classes.token, token], np.r_[classes.level, np.array([r["level"] for r in rows], np.uint8)])


def groups_at(level: int) -> int:
    """How many groups frequent tokens are dealt to, for sets of 2 ** level tokens or more."""
    return max(1, (1 << level) // 16)


def signatures(token: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of one set whose base prefix has frequent tokens, with rests and levels (0: a rare token). token: in order of rarity."""
    n = len(token)
    base, out = n // 4 + 1, []
    for size in {n.bit_length() - 1, (n - n // 4).bit_length() - 1}:
        groups = groups_at(size)
        group = np.where(frequent, (tk.mix(token ^ _K) % U(groups)).astype(np.int64), -1)
        end = base
        while True:
            need = min(n, base + len(np.unique(group[:end][frequent[:end]])))
            if need == end:
                break
            end = need
        rank = np.arange(end)
        alone = ~frequent[:end]
        out.append((token[:end][alone], n - rank[alone], np.zeros(alone.sum(), np.uint8)))
        own, of, at, high = (x[:end][~alone] for x in (token, group, np.arange(n), level))
        order = np.lexsort((own, of))
        own, of, at, high = own[order], of[order], at[order], high[order]
        last = np.cumsum(np.bincount(of, minlength=groups))[of]
        i = np.arange(len(own))
        left = np.repeat(i, last - 1 - i)
        right = np.arange(len(left)) - np.repeat(np.cumsum(last - 1 - i) - (last - 1 - i), last - 1 - i) + left + 1
        # Up to the first two common tokens of one group, one token of each group met before the second, and that second one, can be common.
        seen = np.zeros(end + 1, np.int64)
        _, opens = np.unique(group[:end][~alone], return_index=True)
        seen[np.flatnonzero(~alone)[opens] + 1] = 1
        seen = np.cumsum(seen)
        second = np.maximum(at[left], at[right])
        rest = n - second + seen[second]
        out.append((tk.mix(tk.mix(own[left] + U(size + 1) * _K) * _K + own[right]), rest, np.minimum(high[left], high[right])))
    sig, rest, high = (np.concatenate(x) for x in zip(*out, strict=True))
    _, first = np.unique(sig, return_index=True)
    return sig[first], rest[first], high[first]


def index_sets(classes, buckets: int):
    """Postings of each distinct set of a batch by bucket of the signature, or of the signature and a salt."""

    def packed(held):
        sig, node, n, rest, level = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        salts = U(1) << np.maximum(level.astype(np.int64) - SALT_LEVEL, 0).astype(U)
        salt = tk.mix(node.view(U) ^ _K) % salts
        return sent(POSTING_PART, ((sig + salt) % U(buckets)).astype(np.int64), {"sig": sig, "node": node, "n": n, "rest": rest, "salted": (salts > U(1)).astype(np.uint8)})

    def step(batches):
        for batch in batches:
            held, count = [], 0
            for token, level, hot, bounds, doc, rank, node, fresh in ordered_sets(batch, classes.value):
                n = np.diff(bounds)
                inside = rank < (n // 4 + 1)[doc]
                paired = np.zeros(len(n), bool)
                paired[doc[inside & hot]] = True
                plain = inside & (fresh & ~paired)[doc]
                parts = [(token[plain], doc[plain], n[doc[plain]] - rank[plain], np.zeros(plain.sum(), np.uint8))]
                for d in np.flatnonzero(fresh & paired):
                    own = slice(bounds[d], bounds[d + 1])
                    sig, rest, high = signatures(token[own], hot[own], level[own])
                    parts.append((sig, np.full(len(sig), d), rest, high))
                sig, of, rest, high = (np.concatenate(x) for x in zip(*parts, strict=True))
                held.append((sig, node[of], n[of].astype(np.uint32), rest.astype(np.uint32), high.astype(np.uint8)))
                count += len(sig)
                if count > PART_POSTINGS:
                    yield packed(held)
                    count = 0
            if count:
                yield packed(held)

    return step


def some_partner(group: np.ndarray, n: np.ndarray, rest: np.ndarray, salted: np.ndarray) -> np.ndarray:
    """Which postings have another one of their signature with a size that their rest allows. Sorted by (group, n); salted ones have others elsewhere."""
    lowest, highest = (3 * n + 3) // 4, np.minimum(7 * rest // 3 - n, 4 * n // 3)
    place = group * (1 << 32) + n
    near = np.searchsorted(place, group * (1 << 32) + np.maximum(highest, 0), side="right") - np.searchsorted(place, group * (1 << 32) + lowest, side="left")
    return (near - (highest >= n) > 0) | (salted & (highest >= lowest))


def meet_postings(batch: pa.RecordBatch):
    """Pairs (sig null, a, b), and postings of signatures with more than MANY + 1 members (sig, a, n, rest).

    Members of a shorter list are paired with each other, those of a longer one with its pivot.
    """
    sig, node, n, rest, salted = (read(batch, c, k) for c, k in (("sig", U), ("node", np.int64), ("n", np.uint32), ("rest", np.uint32), ("salted", np.uint8)))
    order = np.lexsort((node, sig))
    order = order[an.first_of_groups(sig[order], node[order])] if len(sig) else order
    sig, node, n, rest, salted = sig[order], node[order], n[order].astype(np.int64), rest[order].astype(np.int64), salted[order] > 0
    for _ in range(2):
        group = np.cumsum(an.first_of_groups(sig))
        order = np.lexsort((n, group))
        sig, node, n, rest, salted = (x[order] for x in (sig, node, n, rest, salted))
        keep = some_partner(group, n, rest, salted)
        sig, node, n, rest, salted = (x[keep] for x in (sig, node, n, rest, salted))
    if not len(sig):
        return
    at = np.flatnonzero(an.first_of_groups(sig))
    size = np.diff(np.r_[at, len(sig)])
    group = np.repeat(np.arange(len(at)), size)
    long = (size[group] > MANY + 1) | salted
    pivot = np.lexsort((node, -(rest / n), group))[at][group]
    sides = [(np.flatnonzero(long), pivot[long])]
    for step in range(1, MANY + 1):
        one = np.flatnonzero(~long[:-step] & (group[:-step] == group[step:]))
        sides.append((one, one + step))
    one, two = (np.concatenate(x) for x in zip(*sides, strict=True))
    met = (node[one] != node[two]) & possible(n[one], rest[one], n[two], rest[two])
    one, two = one[met], two[met]
    a, b = np.minimum(node[one], node[two]), np.maximum(node[one], node[two])
    order = np.lexsort((b, a))
    order = order[an.first_of_groups(a[order], b[order])] if len(a) else order
    a, b = a[order], b[order]
    none, some = pa.nulls(len(a), pa.int64()), long.sum()
    yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b), none, none], names=["sig", "a", "b", "n", "rest"])
    yield pa.RecordBatch.from_arrays([pa.array(sig[long].view(np.int64)), pa.array(node[long]), pa.nulls(some, pa.int64()), pa.array(n[long]), pa.array(rest[long])], names=["sig", "a", "b", "n", "rest"])


def possible(n_a, rest_a, n_b, rest_b):
    """Sizes and rests that can still reach 0.75: 3/7 of both sizes is shared. For arrays and columns."""
    both = 3 * (n_a + n_b)
    return (7 * rest_a >= both) & (7 * rest_b >= both) & (4 * n_a >= 3 * n_b) & (4 * n_b >= 3 * n_a)


def emit_sets(wanted):
    """(node, tokens) of rows whose rid may be wanted; a node of several rows may come more than once, which only repeats a check."""

    def step(batches):
        table = wanted.value
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            maybe = table[(rid & ((1 << MAP_BITS) - 1)).astype(np.int64)]
            if not maybe.any():
                continue
            some = batch.filter(pa.array(maybe))
            for _, _, data, offs in tk.blocks(some.column("text"), 1 << 20):
                token, bounds = block_sets(data, offs)
                sets = [token[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(token, bounds)), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return step


def check_pairs(batches):
    """Links among pairs with both token sets."""
    for batch in batches:
        a, b, keep = batch.column("tokens_a"), batch.column("tokens_b"), []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i].as_py(), U), np.frombuffer(b[i].as_py(), U)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 75 * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def ends(pairs: DataFrame) -> DataFrame:
    """Distinct nodes of pairs."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def alike_enough(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs whose sketches differ in no more bits than sets of 0.75 can: 1/7 of both sizes. Each token of just one set changes one bit, so none is lost."""
    for x in "ab":
        pairs = pairs.join(sketched.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    differing = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda x, y: x + y)
    return pairs.filter(7 * differing <= F.col("n_a") + F.col("n_b")).select("a", "b")


def check(pairs: DataFrame, member: DataFrame, read_sets) -> DataFrame:
    """Links among distinct pairs (a, b). member: (node, n, sketch) of each row; read_sets: nodes -> (node, tokens), some further nodes included."""

    def only(nodes, table):
        some = F.broadcast(nodes) if nodes.limit(SMALL_NODES + 1).count() <= SMALL_NODES else nodes
        return table.join(some, "node", "left_semi")

    asked = materialize(ends(pairs), "asked")
    pairs = materialize(alike_enough(pairs, only(asked, member.select("node", "n", "sketch")).dropDuplicates(["node"])), "alike")
    few = materialize(ends(pairs), "ends")
    sets = read_sets(few)
    left, right = (only(few, sets).select(F.col("node").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    found = materialize(pairs.join(right, "b").join(left, "a").mapInArrow(tk.lean(check_pairs), "a long, b long"), "found")
    discard(asked, pairs, few, sets)
    return found


def most_of_partner():
    """The largest partner that a posting's rest allows."""
    return F.least(F.floor(7 * F.col("rest") / 3).cast("long") - F.col("n"), F.floor(4 * F.col("n") / 3).cast("long"))


def least_of_partner():
    return F.ceil(3 * F.col("n") / 4).cast("long")


def in_reach(rows: DataFrame) -> DataFrame:
    """Rows without the members of the pivot's component that no member outside it can be linked with by size."""
    reach = rows.filter("root <> main").groupBy("sig").agg(F.min(least_of_partner()).alias("from_n"), F.max(most_of_partner()).alias("to_n"))
    return rows.join(reach, "sig").filter((F.col("root") != F.col("main")) | F.col("n").between(F.col("from_n"), F.col("to_n"))).drop("from_n", "to_n")


def banded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the meeting of members outside their pivot's component with all members, keyed by signature and the bands of the lesser and larger size.

    rows: (sig, node, n, rest, root, main). A posting goes to the bands of partners that its rest allows, first as the lesser of a pair, then as the larger.
    """
    band = lambda c: F.floor(F.log(c) * BANDS).cast("int")
    most, least = most_of_partner(), least_of_partner()
    lesser = F.when(most >= F.col("n"), F.sequence(band("n"), band(most)))
    larger = F.when(most >= least, F.sequence(band(least), band(F.least(most, F.col("n")))))
    as_lesser = rows.select("*", F.explode(lesser).alias("other")).withColumn("low", band("n")).withColumnRenamed("other", "high")
    as_larger = rows.select("*", F.explode(larger).alias("other")).withColumn("high", band("n")).withColumnRenamed("other", "low")
    return as_lesser.select("sig", "low", "high", "node", "n", "rest", "root", "main"), as_larger.select("sig", "low", "high", "node", "n", "rest", "root", "main")


def rest_of_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs in different components that their postings allow. rows: (sig, node, n, rest, root, main)."""
    lesser, larger = banded(rows)
    outside = F.col("root") != F.col("main")
    found = None
    for one, other in ((lesser.filter(outside), larger), (lesser, larger.filter(outside))):
        a, b = (x.select("sig", "low", "high", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "rest", "root"))) for x, k in ((one, "a"), (other, "b")))
        ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
        met = a.join(b, (a["sig"] == b["sig"]) & (a["low"] == b["low"]) & (a["high"] == b["high"]) & ordered & (F.col("root_a") != F.col("root_b")) & possible(F.col("n_a"), F.col("rest_a"), F.col("n_b"), F.col("rest_b")))
        met = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def link(met: DataFrame, member: DataFrame, read_sets) -> DataFrame:
    """(node, root) of all linked nodes. met: what ``meet_postings`` gives."""
    pairs = materialize(met.filter("sig IS NULL").select("a", "b").distinct(), "star-pairs")
    found = check(pairs, member, read_sets)
    roots = components(found)
    rows = met.filter("sig IS NOT NULL").select("sig", F.col("a").alias("node"), "n", "rest")
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ones = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct((F.col("rest") / F.col("n")).alias("share"), "root")).alias("pivot"))
    open_ones = open_ones.filter("lo <> hi").select("sig", F.col("pivot.root").alias("main"))
    rows = materialize(rows.join(open_ones, "sig"), "open")
    later = materialize(rest_of_pairs(in_reach(rows)).join(pairs, ["a", "b"], "left_anti"), "banded-pairs")
    if not later.isEmpty():
        more = check(later, member, read_sets)
        if not more.isEmpty():
            # Later links only join components: they are contracted to links of roots.
            for x in "ab":
                more = more.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(x, F.coalesce(f"root_{x}", x)).drop(f"root_{x}")
            linked = components(more.filter("a <> b").distinct())
            merged = linked.select(F.col("node").alias("root"), F.col("root").alias("top"))
            old = roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            fresh = merged.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
            roots = materialize(old.unionByName(fresh), "roots")
    discard(rows, pairs, later, found)
    return roots


def cell_levels(table: DataFrame) -> np.ndarray:
    """One byte for each cell: a table of fixed size, which is broadcast."""
    parts = an.meet(table.filter("bucket IS NOT NULL").select("bucket", "counts"), CELL_PARTS).mapInArrow(tk.lean(add_cells), "bucket int, levels binary").collect()
    level = np.zeros((CELL_PARTS, (1 << CELL_BITS) // CELL_PARTS), np.uint8)
    for r in parts:
        level[r["bucket"]] = np.frombuffer(r["levels"], np.uint8)
    return level.ravel()


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, root, n_shingles, component_id) of each row; rid: hash of its id and text; root: the component's key."""
    # Token sets are long rows: a worker gets few at a time.
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        return found_components(docs, id_col, text_col)


def found_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = text_bytes(docs, text_col)
    schema = T.StructType().add("rid", "long").add("doc_id", rows.schema["doc_id"].dataType).add("n", "long").add("node", "long").add("sketch", T.ArrayType(T.LongType())).add("bucket", "integer").add("counts", "binary")
    table = materialize(rows.mapInArrow(tk.lean(sets_and_cells), schema), "sets")
    member = table.filter("bucket IS NULL").select("rid", "doc_id", "n", "node", "sketch")
    levels = cell_levels(table)
    mean = (member.agg(F.sum("n")).first()[0] or 0) / (1 << CELL_BITS)
    noise = int(np.floor(np.log2(mean + 4 * mean**0.5 + 1)))
    classes = Classes(levels, noise, np.zeros(0, U), np.zeros(0, np.uint8))
    shared = spark.sparkContext.broadcast(classes)
    buckets = packed_buckets(total // 6 // 4 * 24)
    few = partitions_for(spark, buckets)
    counts = an.meet(rows.select("text").mapInArrow(present(count_prefixes(shared, buckets)), COUNT_PART), few)
    counts = materialize(counts.mapInArrow(by_bucket(add_counts(MANY)), "token long, level int"), "counts")
    shared = spark.sparkContext.broadcast(listed_tokens(counts, classes))
    discard(counts)
    postings = an.meet(rows.select("text").mapInArrow(present(index_sets(shared, buckets)), POSTING_PART), few)
    met = materialize(postings.mapInArrow(by_bucket(meet_postings), "sig long, a long, b long, n long, rest long"), "postings")

    def read_sets(nodes: DataFrame) -> DataFrame:
        """One row stands for each node; a bit map of fixed size tells which rows may be asked for, others that share a bit are never joined."""
        reps = member.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid"))
        at = F.col("rid").bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
        bits = reps.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        packed = np.zeros((1 << MAP_BITS) // 8, np.uint8)
        for r in bits:
            packed[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        wanted = spark.sparkContext.broadcast(Bits(packed))
        return materialize(rows.select("rid", "text").mapInArrow(tk.lean(emit_sets(wanted)), "node long, tokens binary"), "token-sets")

    roots = link(met, member, read_sets)
    discard(met)
    out = member.join(roots, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    least = out.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return out.join(least, "root", "left").select("rid", "doc_id", F.coalesce("root", "rid").alias("root"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without all but one of each component: the least id stays, among null ids one by a hash.

    Rows alike in id and text are one document; where they differ in other columns, the row of the least hash stays. Columns may have any names.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("best")).select("best.rid").distinct()
    whole = docs.select(row_key(id_col, text_col).alias("rid"), F.xxhash64(*docs.columns).alias("order"), F.struct(*docs.columns).alias("whole"))
    return whole.join(best, "rid", "left_semi").groupBy("rid").agg(F.min_by("whole", "order").alias("whole")).select("whole.*")


class Bits:
    """A packed bit map that is looked up by an array of positions."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


LINKS_SQL = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link UNION ALL SELECT doc_id, doc_id FROM dw),
walk AS (SELECT x, y FROM edge UNION SELECT walk.x, edge.y FROM walk JOIN edge ON walk.y = edge.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM walk GROUP BY x)
"""
SQL = f"""
WITH RECURSIVE {LINKS_SQL.format(docs="documents")}
SELECT dw.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id JOIN comp ON comp.doc_id = dw.doc_id
"""

QUERIES = {"op2_jaccard_components": op2_jaccard_components}
ORACLE_SQL = {"op2_jaccard_components": SQL}
