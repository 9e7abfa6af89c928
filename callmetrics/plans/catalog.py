"""All registered queries and their SQL."""

from __future__ import annotations

from . import analysis, envelopes, fleet, operations, recordings, tables

_PARTS = (analysis, operations, fleet, recordings, tables, envelopes)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
