"""Numeric column expressions with the arithmetic of the statistics language the pipelines come from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_log(x: ColumnOrName) -> Column:
    """Natural log with log(0) = -Infinity and log(negative) = NaN; NULL stays NULL."""
    x = as_column(x).cast("double")
    return (
        F.when(x == 0, F.lit(float("-inf")))
        .when(x < 0, F.lit(float("nan")))
        .otherwise(F.log(x))
    )


def ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def per_population(
    x: ColumnOrName, population: ColumnOrName, per: float = 100_000, pop_unit: float = 1
) -> Column:
    """``x`` per ``per`` persons; ``pop_unit`` says how many persons one unit of ``population`` stands for."""
    return ratio(as_column(x).cast("double") * F.lit(float(per)), as_column(population) * F.lit(float(pop_unit)))


def log_per_head(x: ColumnOrName, population: ColumnOrName, pop_unit: float = 1) -> Column:
    return safe_log(per_population(x, population, 1, pop_unit))


def weighted_share(percent: ColumnOrName, base: ColumnOrName) -> Column:
    """``percent`` of ``base``, e.g. children covered out of children born."""
    return as_column(percent).cast("double") * as_column(base) * F.lit(0.01)


def round_half_even(x: ColumnOrName, digits: int = 0) -> Column:
    return F.bround(as_column(x), digits)


def nan_to_null(x: ColumnOrName) -> Column:
    x = as_column(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def threshold_flag(x: ColumnOrName, k: float) -> Column:
    """1 at or above ``k``, 0 below, NULL where ``x`` is missing."""
    x = as_column(x)
    return F.when(x.isNotNull(), (x >= F.lit(k)).cast("int"))


def active_level(total: ColumnOrName, removed: Iterable[ColumnOrName]) -> Column:
    left = as_column(total)
    for part in removed:
        left = left - as_column(part)
    return left


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
