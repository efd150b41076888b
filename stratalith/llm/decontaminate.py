"""Benchmark decontamination: a prefix-filtered set join of word shingles, DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (an item with fewer words is one window).
It is contained in a document iff all its shingles occur there, one after another. So one of them, the
necessary prefix of a set that must be contained whole, is enough to find every occurrence: the rarest
of the window's shingles in the documents. Steps: match the benchmark's shingles at document positions,
count each over all documents, order a window's shingles by that rarity, join the rarest with its
positions, drop starts that violate the positional bound (before the first word) or the length bound
(past the last word), and verify that each other shingle stands at its own offset.

Shingles have ``shingle`` words, or all the window's words if it has fewer. Their text is the key; no
hash is involved, so a match is exact.

Defined results: null or wordless texts have no words; wordless items match nothing; rows that repeat a
doc_id are told apart by their text and rows alike in both give equal rows; an empty benchmark marks nothing.
Further input columns are ignored. Nothing of the documents is broadcast. The benchmark's shingles are
broadcast up to ``broadcast_rows`` distinct ones; beyond it, the same join runs by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, row_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 1_000_000
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text):
    """Lower-cased words (A-Z only); null or wordless: an empty array."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOW), SEPARATORS), lambda w: w != "")


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words): the distinct windows of each item."""
    words = benchmark.select("item_id", word_array(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, F.lit(window)))).alias("words")).distinct()


def shingled(windows: DataFrame, shingle: int) -> DataFrame:
    """One row per distinct window text and shingle of it: (window, n_words, offset, width, key)."""
    w = windows.select(F.array_join("words", " ").alias("window"), "words", F.size("words").alias("n_words")).dropDuplicates(["window"])
    width = F.least(F.lit(shingle), F.col("n_words"))
    w = w.withColumn("width", width)
    keys = F.transform(F.sequence(F.lit(0), F.col("n_words") - F.col("width")), lambda i: F.array_join(F.slice("words", i + 1, F.col("width")), " "))
    return w.select("window", "n_words", "width", F.posexplode(keys).alias("offset", "key"))


def shingle_hits(docs: DataFrame, grams: DataFrame, shingle: int, broadcast_rows: int) -> DataFrame:
    """(row, doc_id, size, pos, key): where documents have a shingle of the benchmark, and how many words they have."""
    keys = grams.select("width", "key").distinct()
    small = keys.limit(broadcast_rows + 1).count() <= broadcast_rows
    found = []
    words = docs.select(row_key().alias("row"), "doc_id", word_array(F.col("text")).alias("w"))
    for n in range(1, shingle + 1):
        side = keys.filter(F.col("width") == n).select("key")
        if side.isEmpty():
            continue
        # A shingle is built only at words that start one of the benchmark's.
        first = side.select(F.substring_index("key", " ", 1).alias("first")).distinct()
        at = words.select("row", "doc_id", "w", F.size("w").alias("size"), F.posexplode("w").alias("pos", "first"))
        if small:
            at = at.join(F.broadcast(first), "first", "left_semi")
        at = at.filter(F.col("pos") + n <= F.col("size"))
        at = at.select("row", "doc_id", "size", "pos", reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.element_at("w", F.col("pos") + 1 + i) for i in range(n)]).alias("key"))
        found.append(at.join(F.broadcast(side) if small else side, "key"))
    if not found:
        return words.select("row", "doc_id", F.lit(0).alias("size"), F.lit(0).alias("pos"), F.lit("").alias("key")).filter(F.lit(False))
    return reduce(DataFrame.unionByName, found).select("row", "doc_id", "size", "pos", "key")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Occurrences (row, doc_id, start, n_words, window) of the benchmark's windows in documents."""
    windows = windows_of(benchmark, window)
    grams = materialize(shingled(windows, shingle), "bench-shingles")
    hits = materialize(shingle_hits(docs, grams, shingle, broadcast_rows).distinct(), "shingle-hits")
    seen = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A window with a shingle that no document has is in no document.
    ranked = grams.join(seen, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = W.partitionBy("window").orderBy("n", "offset")
    prefix = ranked.withColumn("rank", F.row_number().over(rare)).filter("rank = 1 AND n > 0").select("window", "n_words", "width", "offset", "key")
    small = prefix.limit(broadcast_rows + 1).count() <= broadcast_rows
    cand = hits.join(F.broadcast(prefix) if small else prefix, "key").withColumn("start", F.col("pos") - F.col("offset"))
    cand = cand.filter("start >= 0 AND start + n_words <= size").select("row", "doc_id", "window", "n_words", "width", "start").distinct()
    need = cand.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("width"))))
    want = grams.select("window", F.col("offset").alias("i"), "key")
    need = need.join(F.broadcast(want) if small else want, ["window", "i"]).withColumn("pos", F.col("start") + F.col("i"))
    have = hits.select("row", "pos", "key").distinct()
    exact = need.join(have, ["row", "pos", "key"], "left_semi").groupBy("row", "doc_id", "window", "n_words", "width", "start").agg(F.count(F.lit(1)).alias("n"))
    return exact.filter("n = n_words - width + 1").select("row", "doc_id", "start", "n_words", "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Per document row: row, doc_id, n_words, n_hit, items (sorted array of item ids as text)."""
    found = materialize(contamination(docs, benchmark, **how), "bench-windows")
    spot = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_words") - 1)).alias("pos")).distinct()
    n_hit = spot.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    of = windows_of(benchmark, how.get("window", WINDOW)).select("item_id", F.array_join("words", " ").alias("window")).distinct()
    items = found.select("row", "window").distinct().join(of, "window").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    marks = n_hit.join(items, "row", "left")
    base = docs.select(row_key().alias("row"), "doc_id", F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    return base.join(marks, "row", "left").select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, as they are; columns may have any names."""
    hit = materialize(contamination(docs, benchmark, broadcast_rows=broadcast_rows, **how).select("row").distinct(), "contaminated")
    small = hit.limit(broadcast_rows + 1).count() <= broadcast_rows
    whole = docs.select(row_key().alias("row"), F.struct(*docs.columns).alias("whole"))
    return whole.join(F.broadcast(hit) if small else hit, "row", "left_anti").select("whole.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def found_sql(docs: str) -> str:
    """DuckDB SQL: per doc_id the words, the hit positions and the items, by direct comparison of windows."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOW}')"
    return f"""
    dw AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS w FROM {docs}),
    bw AS (SELECT item_id, regexp_extract_all({low}, '{word}') AS w FROM benchmark),
    bwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
             FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bwin),
    dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
             FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
    hit AS (SELECT DISTINCT doc_id, i, dwin.n, item_id FROM dwin JOIN bwin ON dwin.win = bwin.win AND dwin.n = bwin.n),
    pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit)
    """


SQL = f"""
WITH {found_sql("documents")},
h AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL = {"op4_decontaminate": SQL}
