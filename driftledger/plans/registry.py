"""All registered queries and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import integrity_queries, range_queries, record_queries, stream_queries, verdict_queries
from .tables import Tables


def _over_tables(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))


_MODULES = (range_queries, record_queries, integrity_queries, stream_queries, verdict_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _over_tables(q) for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
