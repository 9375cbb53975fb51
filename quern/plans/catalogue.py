"""All queries outside the training-data subpackage."""

from __future__ import annotations

from . import search_queries, text_queries, upkeep

_PARTS = [upkeep, text_queries, search_queries]

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
