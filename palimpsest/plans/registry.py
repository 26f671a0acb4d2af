"""All registered queries with their SQL, by the ids of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under an id of the survey, with DuckDB SQL for the same rows where SQL can express them."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# the plans register themselves
from palimpsest.plans import aggregate, graph, maintenance, read, retrieval, scalar, stateful, write  # noqa: E402, F401
