"""Registered queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harness.adapters import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(needs or [], sql)
        return fn

    return add
