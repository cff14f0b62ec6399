"""All queries over the reference tables, with the SQL that must give equal rows."""

from __future__ import annotations

from folioflux.plans import graph_queries, record_queries, table_queries, text_queries  # noqa: F401  each registers its queries
from folioflux.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
