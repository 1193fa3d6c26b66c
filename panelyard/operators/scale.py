"""Whole-frame scaling. The statistics are one scalar subquery, so no window spans the frame and the rows stay
where they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_stats(df: DataFrame, aggregates: list) -> DataFrame:
    return df.withColumn("_stats", df.agg(F.struct(*aggregates).alias("s")).scalar())


def zscore(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """(x - mean) / sample sd, missing values left out of both; NULL for a constant column."""
    named = columns if isinstance(columns, Mapping) else {f"{c}_z": c for c in columns}
    stats = [
        a
        for n, c in named.items()
        for a in (F.avg(c).alias(f"m_{n}"), F.stddev_samp(c).alias(f"s_{n}"))
    ]
    return (
        _with_stats(df, stats)
        .withColumns(
            {n: F.try_divide(F.col(c) - F.col(f"_stats.m_{n}"), F.col(f"_stats.s_{n}")) for n, c in named.items()}
        )
        .drop("_stats")
    )


def centre(df: DataFrame, columns: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``{new: (column, factor)}``: ``column * factor`` minus its mean."""
    stats = [F.avg(F.col(c) * F.lit(k)).alias(n) for n, (c, k) in columns.items()]
    return (
        _with_stats(df, stats)
        .withColumns({n: F.col(c) * F.lit(k) - F.col(f"_stats.{n}") for n, (c, k) in columns.items()})
        .drop("_stats")
    )


def offset_from(df: DataFrame, column: str, into: str, base: float | None = None) -> DataFrame:
    """``column`` counted from ``base`` (by default the smallest value)."""
    start = F.lit(base) if base is not None else df.agg(F.min(column)).scalar()
    return df.withColumn(into, F.col(column) - start)
