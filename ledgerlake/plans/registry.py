"""All relational queries by name, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.operators import analysis, consensus, economics, features, functional, ingest, metrics, predicates, repetition, routing
from ledgerlake.plans.dialect import duckdb_sql, spark_sql

SQL: dict[str, str] = {}
for family in (ingest, predicates, metrics, routing, consensus, economics, features):
    SQL |= family.SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: spark_sql(text) for name, text in SQL.items()} | functional.QUERIES | repetition.QUERIES | analysis.QUERIES
ORACLE_SQL: dict[str, str] = {name: duckdb_sql(text) for name, text in SQL.items()} | {name: duckdb_sql(text) for name, text in functional.ORACLE.items()} | repetition.ORACLE | analysis.ORACLE
FLAGSHIP = "met18_revenue_by_service_day"
