"""All queries of the graph engine, with their SQL."""
from __future__ import annotations

from fadegraph.plans import cypher_queries, graph_queries, search_queries, text_queries

_MODULES = [graph_queries, search_queries, text_queries, cypher_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
