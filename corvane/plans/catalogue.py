"""All queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

from . import search, usage_queries, web

_MODULES = [search, web, usage_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
