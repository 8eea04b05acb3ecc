"""Every registered query and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.plans import (
    graph_queries,
    ledger_queries,
    mixed_queries,
    receiving_queries,
    restart_queries,
    run_queries,
    source_queries,
)

MODULES = [receiving_queries, ledger_queries, mixed_queries, graph_queries, restart_queries, run_queries, source_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
