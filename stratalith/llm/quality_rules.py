"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic is beyond a cutoff. The cutoffs of a stratum (language) come
from its labelled good documents: along a fixed grid from the loosest to the strictest cutoff, a cutoff is
accepted while an exact binomial test shows that it rejects a good document of that stratum with probability
under the rule's share of ``limit``; the first cutoff that isn't shown ends the walk (a fixed sequence needs no
correction along the grid). Over rules and strata the error ``delta`` is divided by Bonferroni, and the rules of
a stratum divide ``limit``, so with probability 1 - delta no stratum loses more than ``limit`` of its good
documents to the rules. A stratum with too few labels has no cutoffs and loses none.

Base rules are fixed: fewer than 20 words, or over 30 % of words in repeated 8-word windows.

Defined results: a null or empty text has 0 words and fails the base rules; a null stratum is the stratum
``unknown``; null labels aren't used, repeated labels of a document count as the least; labelled rows that fail
the base rules or whose crc32(doc_id) mod 5 is 0 aren't used for cutoffs; empty tables give empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .features import held_out, text_counts

MIN_WORDS, REPEAT_PERCENT = 20, 30
#: Cutoffs of so many strata (a few dozen bytes each) are broadcast.
SMALL_STRATA = 10_000
#: name: (statistic, whether high values are bad, grid from loose to strict)
RULES = {
    "long_words": ("word_chars / greatest(n_words, 1)", True, [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0]),
    "short_words": ("word_chars / greatest(n_words, 1)", False, [1.0, 1.5, 2.0, 2.5, 3.0, 3.2, 3.4, 3.6]),
    "symbols": ("n_symbols / greatest(word_chars, 1)", True, [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", True, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeat_words": ("n_repeat_words / greatest(n_words, 1)", True, [0.3, 0.27, 0.24, 0.21, 0.18, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04]),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly but for rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a probability after k of n, by bisection."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > delta else (lo, mid)
    return hi


def choose_cutoffs(row: dict, strata: int, limit: float, delta: float) -> dict[str, float]:
    """Cutoffs of one of ``strata`` strata by rule. row: ``n`` and ``rule_i`` = good documents rejected at grid point i."""
    share, error = limit / len(RULES), delta / max(1, len(RULES) * strata)
    out: dict[str, float] = {}
    for rule, (_, _, grid) in RULES.items():
        for i, cutoff in enumerate(grid):
            if row["n"] == 0 or binomial_tail(int(row[f"{rule}_{i}"]), int(row["n"]), share) > error:
                break
            out[rule] = cutoff
    return out


def cutoffs_of(counts: DataFrame, limit: float, delta: float) -> DataFrame:
    """(stratum, cut_RULE, ...): a row for each stratum, null where a rule has no cutoff."""
    strata = counts.count()

    def step(frames):
        for frame in frames:
            found = [choose_cutoffs(row, strata, limit, delta) for row in frame.to_dict("records")]
            yield pd.DataFrame({"stratum": frame["stratum"]} | {f"cut_{rule}": pd.Series([f.get(rule) for f in found], dtype=float) for rule in RULES})

    return counts.mapInPandas(step, ", ".join(["stratum string", *(f"cut_{rule} double" for rule in RULES)]))


def beyond(statistic: str, high: bool, cutoff):
    x = F.expr(statistic)
    return x > cutoff if high else x < cutoff


def apply_rules(docs: DataFrame, labels: DataFrame, *, limit: float = 0.05, delta: float = 0.05, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stratum, counts of features.COUNTS, base_failed, broken: array of rules, kept)."""
    keyed = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.col(stratum).cast("string"), F.lit("unknown")).alias("stratum"))
    counts = text_counts(keyed, id_col=id_col, text_col=text_col, carry=("stratum",))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    table = materialize(counts.withColumn("base_failed", base), "rule-counts")
    good = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = table.filter("NOT base_failed").join(good, "doc_id", "left_semi")
    sums = [F.sum(beyond(s, high, c).cast("long")).alias(f"{rule}_{i}") for rule, (s, high, grid) in RULES.items() for i, c in enumerate(grid)]
    counts = materialize(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums), "stratum-counts")
    cutoffs = materialize(cutoffs_of(counts, limit, delta), "cutoffs")
    # Strata are languages, most often few; more are joined by shuffle.
    few = cutoffs.limit(SMALL_STRATA + 1).count() <= SMALL_STRATA
    out = table.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    cut = {rule: F.nanvl(F.col(f"cut_{rule}"), F.lit(None).cast("double")) for rule in RULES}
    broken = [F.when(cut[rule].isNotNull() & beyond(s, high, cut[rule]), F.lit(rule)) for rule, (s, high, _) in RULES.items()]
    out = out.withColumn("broken", F.filter(F.array(*broken), lambda x: x.isNotNull())).drop(*(f"cut_{rule}" for rule in RULES))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL: dict[str, str] = {}
