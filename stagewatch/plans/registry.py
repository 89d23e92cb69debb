"""Registered queries: for each key, a Spark callable ``(spark, sf_dir) -> DataFrame``
and (where SQL can express it) the equivalent DuckDB SQL used as the oracle.

Each callable reads the driver's tables, or tables Spark derives from them, in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import the modules whose import registers queries."""
    from . import queries_core, queries_io, queries_ops, queries_stream  # noqa: F401
