"""Queries over the test tables, one for each capability, with their SQL."""

from . import aggregates, flagship, joins, predicates, projections, regressions, scans, sorts, sql_queries, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "flagship", "joins", "predicates", "projections", "regressions", "scans", "sorts", "sql_queries", "tables"]
