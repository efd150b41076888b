"""All reference queries by name, and the DuckDB SQL each is held against."""

from __future__ import annotations

from . import extra, records, relational, spatial  # noqa: F401  registration
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
