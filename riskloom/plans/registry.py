"""All reference-side queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans import connectors, engineering, extraction, extras, features, graphs, learning, models, monitoring, quality, records, scalar, scoring

MODULES = (quality, scalar, features, graphs, extraction, engineering, scoring, monitoring, learning, models, extras, connectors, records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.ORACLE_SQL
    return found
