"""Queries over the test tables, each with a SQL text that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def load_all() -> None:
    from importlib import import_module
    for part in ("sources", "speakers", "conversations", "windows", "cues", "topics", "scoring",
                 "selection", "ensemble", "text", "streams", "flows"):
        import_module(f"turnwise.catalog.{part}")
