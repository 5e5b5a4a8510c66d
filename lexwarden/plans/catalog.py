"""All core queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexwarden.plans import delivery, evaluation, packed_fields, preparation

MODULES = (preparation, evaluation, packed_fields, delivery)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query functions by name."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
