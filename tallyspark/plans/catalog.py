"""Every registered query with its reference SQL, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import cell_queries, design_queries, ingest_queries, ranked_queries, report_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (ingest_queries, report_queries, ranked_queries, design_queries, cell_queries, stream_queries)


def all_queries() -> dict[str, Query]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
