"""All queries over the standard tables, by name, with SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add


from ethoflow.plans import database, files, fits, frames, inference, kinematics, prototypes, report, saved, stores, tables  # noqa: E402, F401  they fill QUERIES
