"""All registered queries and their SQL."""

from __future__ import annotations

from . import account_queries, lake_queries, lookup_queries, raw_queries, serving_queries, source_queries, tag_queries, update_queries, utxo_queries

_GROUPS = (utxo_queries, account_queries, lake_queries, lookup_queries, serving_queries, tag_queries, update_queries, raw_queries, source_queries)
QUERIES = {name: f for group in _GROUPS for name, f in group.QUERIES.items()}
SQL = {name: sql for group in _GROUPS for name, sql in group.SQL.items()}
