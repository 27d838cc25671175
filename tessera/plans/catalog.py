"""All registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.analytics import ANALYTICS, keyword_top
from tessera.plans.model import Model
from tessera.plans.statements import STATEMENTS

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Callable[[Model], DataFrame], str | None]] = {**STATEMENTS, **ANALYTICS}


def _query(run: Callable[[Model], DataFrame]) -> Query:
    return lambda spark, folder: run(Model(spark, folder))


def queries() -> dict[str, Query]:
    return {name: _query(run) for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search over all documents, the best hundred."""
    return keyword_top(Model(spark, folder))
