"""All queries of the engine by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grafloom.plans import evaluation, extensions, graph, operations, retrieval, services, streams, texts

MODULES = (texts, retrieval, graph, operations, services, evaluation, streams, extensions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.BOOK.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.BOOK.sql.items()}
