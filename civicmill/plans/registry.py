"""Name -> query, and name -> DuckDB SQL that gives the same rows."""

from __future__ import annotations

from civicmill.plans import aggregates, cases, civic_views, details, extracts, graphs, labels, listings, mutations, quality, relational, scalars, sources, streams, texts, windows  # noqa: F401  they register
from civicmill.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "J09_conflicts"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
