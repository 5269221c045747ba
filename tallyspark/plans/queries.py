"""The queries that the driver runs, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_cleaning, queries_detect, queries_kpi, queries_plan, queries_scalar, queries_store

_PARTS = [queries_kpi, queries_scalar, queries_cleaning, queries_detect, queries_plan, queries_store]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
