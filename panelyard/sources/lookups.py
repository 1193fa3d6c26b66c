"""Small tables that live in the program."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def lookup_column(column: Column | str, table: Mapping[object, object]) -> Column:
    """Value of a literal map, NULL for an unknown key; evaluated in place without a join."""
    key = F.col(column) if isinstance(column, str) else column
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def invert_groups(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """``{group: members}`` to ``{member: group}``."""
    return {member: group for group, members in groups.items() for member in members}
