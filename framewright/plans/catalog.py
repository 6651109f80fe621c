"""All queries of the library over the given tables, and their SQL, by name."""

from __future__ import annotations

from . import checks, coding, files, layer_queries, oracles, queries

QUERIES = queries.QUERIES | coding.QUERIES | files.QUERIES | layer_queries.QUERIES | checks.QUERIES
ORACLES = oracles.ORACLES | coding.SQL | files.SQL | layer_queries.SQL | checks.SQL
