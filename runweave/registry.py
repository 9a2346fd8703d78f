"""All queries of the library by name, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import corpus, evidence, graphs, ledger, records, scalars, search, sessions, source, statements, streams, telemetry

MODULES = (telemetry, corpus, evidence, graphs, ledger, records, scalars, search, sessions, source, statements, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
