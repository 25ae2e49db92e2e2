"""Registered queries: one Spark plan per operator, each with its DuckDB oracle.

Every query reads the driver's tables (or data Spark derives from them) at
``sf_dir`` and runs over whole tables.  Result columns are aliased to the
same names as the oracle SQL; MAP and ARRAY results are rendered as canonical
strings so the two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from trafficlens.plans import (q_extract, q_generate, q_json, q_match,  # noqa: F401
                                   q_store, q_streaming)
