"""Registered queries over the benchmark tables, each with its SQL twin where one exists."""

from panelyard.plans import (  # noqa: F401  (importing registers the queries)
    aggregates,
    cleaning,
    composites,
    functions,
    joining,
    modelling,
    reshaping,
    scenarios,
    sourcing,
    windowing,
)
from panelyard.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
