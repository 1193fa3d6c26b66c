"""Wide and long forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.text import header_part, strip_prefix


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    names_to: str,
    values_to: str,
    names_prefix: str | None = None,
    drop_missing: bool = False,
    cast: str | None = None,
) -> DataFrame:
    """One row per id and value column; optionally strip a name prefix and drop missing values."""
    wide = df.select(*ids, *[F.col(f"`{v}`").try_cast(cast).alias(v) if cast else F.col(f"`{v}`") for v in values])
    long = wide.unpivot(list(ids), [F.col(f"`{v}`") for v in values], names_to, values_to)
    if names_prefix:
        long = long.withColumn(names_to, strip_prefix(names_to, names_prefix))
    return long.filter(F.col(values_to).isNotNull()) if drop_missing else long


def split_names(columns: Sequence[str], sep: str = "_") -> dict[str, dict[str, str]]:
    """``{code: {measure: column}}`` from names such as ``measure_code``, split at the last separator."""
    parts: dict[str, dict[str, str]] = {}
    for column in columns:
        measure, found, code = column.rpartition(sep)
        if found:
            parts.setdefault(code, {})[measure] = column
    return parts


def to_long_multi(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], names_to: str, sep: str = "_", code_type: str = "string"
) -> DataFrame:
    """Several value columns at once: names are ``measure_code``, every code becomes one row with one column
    per measure. One generator over the row, no join and no shuffle."""
    parts = split_names(columns, sep)
    measures = list(dict.fromkeys(m for group in parts.values() for m in group))
    kinds = {m: df.schema[next(g[m] for g in parts.values() if m in g)].dataType for m in measures}
    rows = [
        F.struct(
            F.lit(code).cast(code_type).alias(names_to),
            *[(F.col(f"`{g[m]}`") if m in g else F.lit(None)).cast(kinds[m]).alias(m) for m in measures],
        )
        for code, g in parts.items()
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def _one_row_per_cell(wide: DataFrame, counts: Sequence[str], other: str | None, label: str) -> DataFrame:
    """Stop on a repeated cell or an unlisted name instead of losing values."""
    repeated = F.greatest(*counts, F.lit(0), F.lit(0)) > 1
    check = F.when(repeated, F.raise_error(F.lit(f"{label}: a cell occurs more than once")).cast("boolean"))
    if other:
        check = check.when(F.col(other) > 0, F.raise_error(F.lit(f"{label}: a name is not listed")).cast("boolean"))
    return wide.filter(check.otherwise(True)).drop(*counts, *([other] if other else []))


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    names: Sequence[object],
    values: Sequence[str],
    glue: str = "{name}",
    other: str = "error",
) -> DataFrame:
    """One column per listed name (and value column): ``glue`` may use ``{name}`` and ``{value}``.

    The names are given, so no extra job looks for them. A row with another name stops the job, unless ``other`` is
    ``"drop"``. A cell that occurs more than once stops it as well.
    """
    cells = [
        F.max(F.when(F.col(names_from) == F.lit(n), F.col(v))).alias(glue.format(name=n, value=v))
        for n in names
        for v in values
    ]
    counts = [F.count_if(F.col(names_from) == F.lit(n)).alias(f"_n{i}") for i, n in enumerate(names)]
    listed = F.coalesce(F.col(names_from).isin(*names), F.lit(False)) if names else F.lit(False)
    wide = df.groupBy(*ids).agg(*cells, *counts, F.count_if(~listed).alias("_other"))
    checked = _one_row_per_cell(wide, [f"_n{i}" for i in range(len(names))], "_other" if other == "error" else None, "to_wide")
    return checked.drop("_other")


def transpose_indicators(
    df: DataFrame,
    entity: str,
    indicator: str,
    years: Sequence[str],
    indicators: Mapping[str, str] | Sequence[str],
    year: str = "Year",
    cast: str = "double",
) -> DataFrame:
    """Rows per (entity, indicator) with a column per year -> rows per (entity, year) with a column per
    indicator. ``indicators`` picks indicators and may map long names to short ones; a picked one that occurs twice
    for an entity stops the job."""
    short = indicators if isinstance(indicators, Mapping) else {i: i for i in indicators}
    long = to_long(df, [entity, indicator], list(years), year, "_value", cast=cast)
    long = long.withColumn(year, F.col(year).cast("int"))
    cells = [F.max(F.when(F.col(indicator) == F.lit(i), F.col("_value"))).alias(n) for i, n in short.items()]
    counts = [F.count_if(F.col(indicator) == F.lit(i)).alias(f"_n{k}") for k, i in enumerate(short)]
    wide = long.groupBy(entity, year).agg(*cells, *counts)
    return _one_row_per_cell(wide, [f"_n{k}" for k in range(len(short))], None, "transpose_indicators")


def expand_periods(
    df: DataFrame,
    entity: str,
    periods: Sequence[str],
    year: str = "Year",
    value: str = "value",
    length: int = 5,
    unit: float = 1,
) -> DataFrame:
    """Columns headed ``1950-1955`` holding period totals -> one row per year with the yearly average.

    A period stands for the ``length`` years up to its end year.
    """
    ends = {p: int(header_part(p)) for p in periods}
    long = to_long(df, [entity], list(periods), "_period", "_total", cast="double")
    end = F.try_element_at(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]), F.col("_period"))
    return expand_period_rows(long.withColumn("_end", end), [entity], "_end", "_total", year, value, length, unit)


def expand_period_rows(
    df: DataFrame, ids: Sequence[str], end: str, total: str, year: str, value: str, length: int = 5, unit: float = 1
) -> DataFrame:
    return df.select(
        *ids,
        F.explode(F.sequence(F.col(end) - (length - 1), F.col(end))).alias(year),
        (F.col(total) * F.lit(unit) / F.lit(length)).alias(value),
    )
