"""Registered queries over the driver tables and their DuckDB equivalents."""

from __future__ import annotations

from . import fit_queries, pair_queries, pipeline_queries, space_queries

FLAGSHIP = "wls_trend"
PARTS = (fit_queries, pair_queries, space_queries, pipeline_queries)
QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in PARTS for k, v in p.SQL.items()}
