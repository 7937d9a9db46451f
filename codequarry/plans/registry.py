"""Queries by name and the SQL that gives the same rows."""

from codequarry.plans import catalogue_queries, code_queries, context_queries, corpus_queries, finding_queries, merge_queries, more_queries, response_queries, scan_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (finding_queries, scan_queries, text_queries, catalogue_queries, more_queries, code_queries, merge_queries, response_queries, context_queries, corpus_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
