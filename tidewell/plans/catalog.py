"""Registered queries and their oracle SQL."""

from tidewell.plans import dialect_queries, service_queries

QUERIES = {**dialect_queries.QUERIES, **service_queries.QUERIES}
ORACLE_SQL = {**dialect_queries.ORACLE_SQL, **service_queries.ORACLE_SQL}
