"""The queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from . import chat, decontaminate, language_id, mixing, ngram_join, quality_gam, quality_rules, substring_dedup, suffix_dedup, toxicity

MODULES = (quality_rules, ngram_join, substring_dedup, decontaminate, toxicity, suffix_dedup, mixing, quality_gam, chat, language_id)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
