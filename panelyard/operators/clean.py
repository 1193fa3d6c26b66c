"""Projections, filters, missing values and cell-level repairs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.numeric import fractional_columns, nan_to_null, threshold_flag


def select_positions(df: DataFrame, positions: Iterable[int | slice | range]) -> DataFrame:
    """Project by 0-based positions; single numbers, ranges and slices may be mixed."""
    names: list[str] = []
    for item in positions:
        if isinstance(item, int):
            names.append(df.columns[item])
        elif isinstance(item, slice):
            names.extend(df.columns[item])
        else:
            names.extend(df.columns[i] for i in item)
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)])


def drop_positions(df: DataFrame, positions: Iterable[int]) -> DataFrame:
    gone = {df.columns[i] for i in positions}
    return df.select(*[F.col(f"`{n}`") for n in df.columns if n not in gone])


def drop_row_index(df: DataFrame) -> DataFrame:
    """Drop the leading row-number column some writers add."""
    return drop_positions(df, [0])


def select_matching(df: DataFrame, fragments: Sequence[str], how: str = "contains") -> DataFrame:
    """Columns whose name contains (or starts with) a fragment, in the order of the fragments."""
    test = {"contains": lambda n, f: f.lower() in n.lower(), "starts_with": lambda n, f: n.startswith(f)}[how]
    names = dict.fromkeys(n for f in fragments for n in df.columns if test(n, f))
    return df.select(*[F.col(f"`{n}`") for n in names])


def rename_affixed(
    df: DataFrame, columns: Iterable[str], prefix: str | None = None, suffix: str | None = None, sep: str = "_"
) -> DataFrame:
    return df.withColumnsRenamed({c: sep.join(p for p in (prefix, c, suffix) if p) for c in columns})


def derive(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Derived columns, each free to use the ones before it."""
    for name, expression in steps.items():
        df = df.withColumn(name, expression)
    return df


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without NULL or NaN in ``columns`` (all columns by default)."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def nan_columns_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: nan_to_null(c) for c in (columns or fractional_columns(df))})


def missing_to_zero(df: DataFrame, text: bool = False) -> DataFrame:
    """NULL (and NaN) to 0 in numeric columns; ``text=True`` also turns missing text into "0"."""
    filled = df.na.fill(0)
    return filled.na.fill("0") if text else filled


def to_number(df: DataFrame, columns: Sequence[str] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """Tolerant cast: text that is no number becomes NULL. All columns but ``skip`` by default."""
    chosen = columns if columns is not None else [c for c in df.columns if c not in set(skip)]
    return df.withColumns({c: F.col(c).try_cast("double") for c in chosen})


def to_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def binarise(df: DataFrame, thresholds: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``{new column: (level column, k)}`` -> 0/1 flags that keep missing levels missing."""
    return df.withColumns({name: threshold_flag(column, k) for name, (column, k) in thresholds.items()})


def rescale(df: DataFrame, column: str, factor: float, where: Column | None = None) -> DataFrame:
    """Multiply a whole column, or only the rows that meet ``where``."""
    scaled = F.col(column) * F.lit(factor)
    return df.withColumn(column, scaled if where is None else F.when(where, scaled).otherwise(F.col(column)))


def patch_cells(df: DataFrame, key: str, patches: Mapping[tuple[str, str], object]) -> DataFrame:
    """Replace single cells addressed by (key value, column), never by row position."""
    by_column: dict[str, dict[str, object]] = {}
    for (row, column), value in patches.items():
        by_column.setdefault(column, {})[row] = value
    changed = {}
    for column, cells in by_column.items():
        kind = df.schema[column].dataType
        expression = F.col(column)
        for row, value in cells.items():
            expression = F.when(F.col(key) == F.lit(row), F.lit(value).cast(kind)).otherwise(expression)
        changed[column] = expression
    return df.withColumns(changed)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
