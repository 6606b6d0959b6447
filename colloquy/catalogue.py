"""Queries over the driver's tables and the SQL that checks them."""

from .plans import block_queries, interval_queries, lookup_queries, row_queries, score_queries, source_queries

MODULES = (block_queries, interval_queries, row_queries, lookup_queries, score_queries, source_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
