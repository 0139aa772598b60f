"""All queries of the warehouse and their SQL, by name."""

from __future__ import annotations

from . import assembly_queries, layout_queries, scalar_queries, star_queries

_MODULES = (scalar_queries, layout_queries, assembly_queries, star_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
