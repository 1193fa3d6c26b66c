"""Grouped and global aggregates. All of them combine on the map side, so a hot group costs one partial row
per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import nan_to_null
from panelyard.functions.categories import category_order


def group_means(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], count_as: str | None = "nrows"
) -> DataFrame:
    """Mean per group over the present values (NULL and NaN left out); NULL for a group without any."""
    means = [F.avg(nan_to_null(F.col(c).cast("double"))).alias(c) for c in columns]
    counts = [F.count(F.lit(1)).alias(count_as)] if count_as else []
    return df.groupBy(*keys).agg(*means, *counts)


def group_sums(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str] | Sequence[str], scale: float = 1
) -> DataFrame:
    """Sums per group, ``{new name: column}`` or a plain list, divided by ``scale``."""
    named = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    return df.groupBy(*keys).agg(
        *[(F.sum(c) / F.lit(scale) if scale != 1 else F.sum(c)).alias(n) for n, c in named.items()]
    )


def sums_by_area(
    df: DataFrame, key: str, columns: Mapping[str, str], scale: float = 1e6, label: str = "variable"
) -> DataFrame:
    """Scaled yearly sums in long form, with the position of each area as its plotting order."""
    names = list(columns)
    wide = group_sums(df, [key], columns, scale)
    return wide.unpivot([key], names, label, "value").withColumn(f"{label}_order", category_order(label, names))


def totals_by(df: DataFrame, time: str, measures: Sequence[str]) -> DataFrame:
    return df.groupBy(time).agg(*[F.sum(m).alias(m) for m in measures])


def kpi_totals(df: DataFrame, time: str, measures: Sequence[str], at: Column | None = None) -> DataFrame:
    """One row: totals of ``measures`` at the last date (or at ``at``), that date, and the days covered.

    One pass: totals per date first, then the last of them.
    """
    daily = totals_by(df, time, measures)
    if at is None:
        picked = [F.max_by(m, time).alias(m) for m in measures] + [F.max(time).alias("last_date")]
    else:
        hit = F.col(time) == at
        picked = [F.max(F.when(hit, F.col(m))).alias(m) for m in measures]
        picked.append(F.max(F.when(hit, F.col(time))).alias("last_date"))
    return daily.agg(*picked, F.datediff(F.max(time), F.min(time)).alias("days_covered"))


def entity_kpi(
    df: DataFrame, entity: str, time: str, measures: Sequence[str], requests: DataFrame | None = None
) -> DataFrame:
    """Values at (entity, date) with the days since the entity's first record.

    ``requests`` (entity, time) asks for many drill-downs at once; without it every panel row is answered.
    """
    first = df.groupBy(F.col(entity).alias("_e")).agg(F.min(time).alias("_first"))
    rows = df if requests is None else df.join(requests.select(entity, time).distinct(), [entity, time], "left_semi")
    return rows.join(first, F.col(entity).eqNullSafe(F.col("_e")), "left").select(
        entity, time, *measures, F.datediff(F.col(time), F.col("_first")).alias("days_since_first")
    )


def global_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<column>_mean``, ``_sd`` (sample), ``_min`` and ``_max``."""
    return df.agg(
        *[
            f(c).alias(f"{c}_{n}")
            for c in columns
            for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )


def mean_squared_error(
    df: DataFrame, observed: str, predicted: str, keep: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    rows = df if keep is None else df.filter(keep)
    error = F.col(observed) - F.col(predicted)
    return rows.groupBy(*by).agg(F.avg(error * error).alias("mse"), F.count(error).alias("n"))


def draw_summary(draws: DataFrame, row_keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample sd over the draws of each forecast row of a long (row, draw, value) table."""
    return draws.groupBy(*row_keys).agg(F.avg(value).alias("est"), F.stddev_samp(value).alias("sd"))


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def first_value(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """The first distinct value under an explicit order (one row)."""
    return df.select(column, *(order or [])).orderBy(*(order or [column])).limit(1).select(column)


def histogram(
    df: DataFrame, value: str, bins: int = 30, facets: Sequence[str] = (), own_range: bool = False
) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest finite value.

    Facets share the edges unless ``own_range`` is set. Bins are numbered from 1 and the last one is closed.
    Empty bins are returned with a count of 0; a range without width is a single bin.
    """
    x = F.col(value).cast("double")
    finite = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    edges = [F.min(x).alias("_lo"), F.max(x).alias("_hi")]
    if own_range and facets:
        bounds = finite.groupBy(*[F.col(f).alias(f"_f{i}") for i, f in enumerate(facets)]).agg(*edges)
        test = F.lit(True)
        for i, f in enumerate(facets):
            test = test & F.col(f).eqNullSafe(F.col(f"_f{i}"))
        ranged = finite.join(bounds, test, "left")
    else:
        both = finite.agg(F.struct(*edges).alias("e")).scalar()
        ranged = finite.withColumn("_e", both).withColumns({"_lo": F.col("_e._lo"), "_hi": F.col("_e._hi")})
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor(F.try_divide(x - F.col("_lo"), width)) + 1, F.lit(bins))
    )
    counted = (
        ranged.select(*facets, "_lo", width.alias("_w"), place.cast("int").alias("bin"))
        .groupBy(*facets, "bin", "_lo", "_w")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most ``bins`` entries per facet.
    filled = counted.groupBy(*facets, "_lo", "_w").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))
    last = F.when(F.col("_w") == 0, F.lit(1)).otherwise(F.lit(bins))
    return filled.withColumn("bin", F.explode(F.sequence(F.lit(1), last))).select(
        *facets,
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("lower"),
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("upper"),
        F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0)).cast("long").alias("n"),
    )
