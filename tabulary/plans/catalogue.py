"""The registered queries: each has a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabulary.desk import QueryDesk
from tabulary.plans.bindings import REGISTRY, RETRIEVED_AT
from tabulary.sources.tables import open_table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function name."""

    def register(run: Run) -> Run:
        if run.__name__ in ENTRIES:
            raise ValueError(f"registered twice: {run.__name__}")
        ENTRIES[run.__name__] = Entry(run, sql)
        return run

    return register


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A registered table by ``database.table``, hidden or not."""
    database, short = name.split(".")
    return open_table(spark, base, REGISTRY.any_table(database, short))


def desk(spark: SparkSession, base: str) -> QueryDesk:
    return QueryDesk(spark, REGISTRY, base, clock=lambda: RETRIEVED_AT)
