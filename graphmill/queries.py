"""The registry of all queries outside the llm subpackage."""

from __future__ import annotations

from .plans import analysis_queries, graph_queries, record_queries, retrieval_queries, search_queries, structure, version_queries, workflow_queries

_PARTS = (analysis_queries, graph_queries, record_queries, retrieval_queries, search_queries, version_queries, structure, workflow_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
