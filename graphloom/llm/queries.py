"""All queries of this subpackage, by name."""

from __future__ import annotations

from graphloom.llm import queries_corpus, queries_dedup, queries_search, queries_statistics

MODULES = [queries_dedup, queries_search, queries_corpus, queries_statistics]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
