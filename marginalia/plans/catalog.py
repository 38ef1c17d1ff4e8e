"""The registered queries of the note engine and their oracles in SQL."""

from __future__ import annotations

from . import check_queries, compare_queries, model_queries, relational_queries, search_queries, text_queries

_ALL = (text_queries.REG, relational_queries.REG, search_queries.REG, compare_queries.REG, model_queries.REG, check_queries.REG)
QUERIES = {name: query for reg in _ALL for name, query in reg.queries.items()}
ORACLES = {name: sql for reg in _ALL for name, sql in reg.oracles.items()}
