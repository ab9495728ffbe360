"""Queries of the engine's own operators, and SQL with the same rows."""

from __future__ import annotations

from .plans import more  # noqa: F401  registers its queries
from .plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
