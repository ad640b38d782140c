"""Names of queries, and the same questions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def named(oracle: str | None = None):
    def register(query):
        QUERIES[query.__name__] = query
        if oracle is not None:
            ORACLE[query.__name__] = oracle
        return query

    return register
