"""The queries over the shared tables, by name, and their SQL."""

from __future__ import annotations

from .plans import check_queries, claim_queries, file_queries, ledger_queries, market_queries, model_queries, report_queries, world_queries

QUERIES = market_queries.QUERIES | model_queries.QUERIES | check_queries.QUERIES | report_queries.QUERIES | claim_queries.QUERIES | file_queries.QUERIES | world_queries.QUERIES | ledger_queries.QUERIES
ORACLE_SQL = market_queries.ORACLE_SQL | model_queries.ORACLE_SQL | check_queries.ORACLE_SQL | report_queries.ORACLE_SQL | claim_queries.ORACLE_SQL | file_queries.ORACLE_SQL | world_queries.ORACLE_SQL | ledger_queries.ORACLE_SQL
FLAGSHIP = "c1_sector_performance"
