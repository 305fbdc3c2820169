"""The registered queries of the panel library and their DuckDB twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import checks, evaluation, features, finance, hurdles, learned, quality, reports, sequence
from tidemark.plans.common import flagship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (features, quality, evaluation, finance, learned, checks, reports, sequence, hurdles):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
