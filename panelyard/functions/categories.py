"""Categorical helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import ColumnOrName, as_column


def category_order(x: ColumnOrName, levels: Sequence[str]) -> Column:
    """0-based position of a label in ``levels``, NULL for a label that is not listed."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), as_column(x))
    return F.when(place > 0, (place - 1).cast("int"))


def dummy_columns(df: DataFrame, column: str, levels: Sequence[object]) -> DataFrame:
    """Treatment coding: one 0/1 column per level but the first; a missing or unlisted level is missing in all."""
    listed = F.col(column).isin(*levels)
    added = {
        f"{column}_{level}": F.when(listed, (F.col(column) == F.lit(level)).cast("int"))
        for level in levels[1:]
    }
    return df.withColumns(added)
