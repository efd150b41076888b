"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask covers the assistant's turns only. A participant
is a role other than the system's; system turns are context in each rendering and never masked.

The query renders each dialogue whole. Pieces of ``turns_per_example`` consecutive turn numbers are rendered apart and
joined for each speaker, so that the turns of a very long dialogue meet only as finished text. ``rotate_perspectives`` alone
gives the pieces as examples of their own: a null or negative turn belongs to example 0 or the negative examples by floor
division. Null turns come first.

Defined results: ``<|`` and ``|>`` of texts and roles become ``< |`` and ``| >``; a null text is empty; a null or empty role is ``unknown``; rows alike in all columns
stay as turns of their own, ordered by (turn, role, text); a conversation with system turns only gives no row;
an empty table gives an empty table; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS_PER_EXAMPLE = 64


def rotate_perspectives(turns: DataFrame, *, turns_per_example: int = TURNS_PER_EXAMPLE, system_role: str = "system") -> DataFrame:
    """(conv_id, example, speaker, n_turns, text, mask): mask is an array of (start, stop) code point ranges of ``text``."""
    return render(turns, F.coalesce(F.floor(F.col("turn") / F.lit(turns_per_example)), F.lit(0)), system_role)


def plain(text):
    """Without the marks of a turn: ``<|`` and ``|>`` of a text or role get a blank between, so that none forges a turn."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def render(turns: DataFrame, example, system_role: str) -> DataFrame:
    t = turns.select(
        "conv_id",
        example.cast("long").alias("example"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.coalesce("role", F.lit("")) == "", F.lit("unknown")).otherwise(plain(F.col("role"))).alias("role"),
        plain(F.coalesce("text", F.lit(""))).alias("text"),
    )
    talks = t.groupBy("conv_id", "example").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = t.filter(F.col("role") != system_role).select("conv_id", F.col("role").alias("speaker")).distinct()
    # null turns first: array_sort puts null struct fields first already
    rows = talks.withColumnRenamed("conv_id", "_c").join(speakers, F.col("_c").eqNullSafe(F.col("conv_id")))

    def head(x):
        return (
            F.when(x["role"] == F.col("speaker"), F.lit("<|assistant|>\n"))
            .when(x["role"] == system_role, F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), x["role"], F.lit("|>\n")))
        )

    body = F.transform("turns", lambda x: F.concat(head(x), x["text"], F.lit("\n<|end|>\n")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("mask"))

    def step(acc, x):
        first = acc["at"] + F.length(head(x))
        last = first + F.length(x["text"]) + F.lit(len("\n<|end|>"))
        own = F.array(F.struct(first.cast("long").alias("start"), last.cast("long").alias("stop")))
        return F.struct((last + 1).cast("long").alias("at"), F.when(x["role"] == F.col("speaker"), F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    return rows.select(
        "conv_id", "example", "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(body, "").alias("text"),
        F.aggregate("turns", zero, step)["mask"].alias("mask"),
    )


def rotate_whole(turns: DataFrame, *, turns_per_piece: int = TURNS_PER_EXAMPLE, system_role: str = "system") -> DataFrame:
    """The columns of ``rotate_perspectives`` with one row for each conversation and speaker; example is 0."""
    # Null turns are a piece before all others.
    at = F.floor(F.col("turn").cast("long") / F.lit(turns_per_piece)).cast("long")
    pieces = render(turns, F.coalesce(at, F.lit(-(1 << 62))), system_role)
    span = F.struct("example", "n_turns", "text", "mask")
    rows = pieces.groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(span)).alias("pieces"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("mask"))

    def step(acc, p):
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["stop"] + acc["at"]).alias("stop")))
        return F.struct((acc["at"] + F.length(p["text"])).alias("at"), F.concat(acc["mask"], moved).alias("mask"))

    return rows.select(
        "conv_id", F.lit(0).cast("long").alias("example"), "speaker",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n_turns"]).alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        F.aggregate("pieces", zero, step)["mask"].alias("mask"),
    )


def op9_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask as text, ``start-stop`` joined by commas."""
    out = rotate_whole(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return out.withColumn("mask", spans)


SQL = """
WITH t AS (SELECT conv_id, 0::BIGINT AS example, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE replace(replace(role, '<|', '< |'), '|>', '| >') END AS role,
 replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
x AS (SELECT t.*, speaker, CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS body, row_number() OVER w AS i,
      sum(length(head || text) + 9) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM x
      WINDOW w AS (PARTITION BY conv_id, example, speaker ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, example, speaker, count(*)::BIGINT AS n_turns, string_agg(body, '' ORDER BY i) AS text,
       coalesce(string_agg(CASE WHEN role = speaker THEN (upto - length(text) - 9)::BIGINT::VARCHAR || '-' || (upto - 1)::BIGINT::VARCHAR END, ',' ORDER BY i), '') AS mask
FROM y GROUP BY conv_id, example, speaker
"""

QUERIES = {"op9_rotate_perspectives": op9_rotate_perspectives}
ORACLE_SQL = {"op9_rotate_perspectives": SQL}
