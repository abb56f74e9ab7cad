"""Every registered query with its oracle SQL, kept side by side so that they cannot drift apart."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import oracle_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the domain tables in ``tables``, which come before it as common table expressions."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle_tables.with_tables(sql, tables)
        return f

    return register


for _module in ("cleaning", "recall", "index", "search", "profiles", "audit", "matching", "recommendation", "social", "evaluation", "activity"):
    importlib.import_module(f"millrace.plans.{_module}_queries")
