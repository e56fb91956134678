"""All queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import q_board, q_checks, q_decisions, q_groups, q_kpi, q_layers, q_marts, q_rows
from gridloom.plans.query import Query

MODULES = (q_marts, q_decisions, q_kpi, q_rows, q_groups, q_board, q_checks, q_layers)


def catalogue() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for q in module.QUERIES:
            if q.name in found:
                raise ValueError(f"two queries are named {q.name}")
            found[q.name] = q
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql() for name, q in catalogue().items()}
