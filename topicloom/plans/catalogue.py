"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import article_queries, cluster_queries, source_queries, summary_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (article_queries, cluster_queries, vector_queries, summary_queries, source_queries):
    QUERIES |= _module.BOOK.queries
    ORACLE_SQL |= _module.BOOK.sql
