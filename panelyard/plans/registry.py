"""The list of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"{name} is registered twice")
        _ENTRIES[name] = Entry(run, sql)
        return run

    return register


def queries() -> dict[str, Query]:
    return {name: entry.run for name, entry in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in _ENTRIES.items() if entry.sql}
