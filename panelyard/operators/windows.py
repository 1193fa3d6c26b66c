"""Ordered panel operators that stay balanced when one entity holds a large part of all rows.

The panel key is (entity, time). What that says about the rows of one entity depends on the type of the time:

* **Dates.** An entity has at most one row per calendar day, so a century is 36,525 rows whatever the size of the
  table. An ordinary ``Window.partitionBy(entity)`` is bounded and is used: one shuffle, one sort, shared by every
  operator that orders the same way.
* **Timestamps and numbers.** Nothing bounds an entity, so the order (entity, time) of the whole table is cut into
  cells by a range partitioning (:func:`range_cells`): as many cells as shuffle partitions, of about equal numbers of
  rows however the times of an entity lie. Windows run per (entity, cell), and what a cell needs to know of the past
  travels as one *carry row*. Cells are runs of the order, so an entity that lies in several cells needs one carry
  row for each but its first, which is at most one for each cell of the table. ``scan=True`` selects this form for
  dates too.

A repeated key has no defined order, so it stops the job in both forms; sum reporting units first with
:func:`panelyard.operators.panel.collapse_to_key`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.distributions import normal_quantile_column
from panelyard.operators.joins import left_join
from panelyard.session import cut_lineage

CELL, ROLE, STATE, START = "_cell", "_role", "_state", "_start"


def entity_columns(entity: str | Sequence[str]) -> list[str]:
    return [entity] if isinstance(entity, str) else list(entity)


def bounded_by_calendar(df: DataFrame, time: str, scan: bool) -> bool:
    kind = df.schema[time].dataType
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.NumericType)):
        raise TypeError(f"{time} is {kind.simpleString()}; order by a date, a timestamp or a number")
    return isinstance(kind, T.DateType) and not scan


# An entity above this many rows is cut; at most this many entities are ever listed as large.
HOT_ROWS = 1_000_000
MOST_LISTED = 20_000


def hot_entities(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Entities (as ``_h0``, ``_h1``...) with more than ``hot_rows`` rows and more than 1/20,000 of all rows.

    Fewer than 20,000 entities can each hold more than 1/20,000 of the rows, so the list has a fixed size bound and
    may be broadcast, whatever the table.
    """
    sizes = df.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    share = sizes.agg(F.sum("_n") / MOST_LISTED).scalar()
    return sizes.filter(F.col("_n") > F.greatest(F.lit(float(hot_rows)), share))


def mark_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_n``: the row count of a large entity, NULL for the others. The list is broadcast, nothing shuffles."""
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return df.join(F.broadcast(hot_entities(df, keys, hot_rows)), match, "left").drop(*[f"_h{i}" for i in range(len(keys))])


def range_cells(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` sorted by ``order`` in cells: ``_cell`` grows along the order, ``_place`` from 0 inside a cell.

    The cut points come from Spark's sample of the order, which balances the cells and decides nothing else; rows that
    agree in all of ``order`` share a cell. Written to reliable storage, so every later use sees the same cells.
    """
    cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(cells, *order).sortWithinPartitions(*order)
    # The number that Spark gives: partition, then position in it.
    numbered = cut_lineage(sorted_rows.withColumn("_place", F.monotonically_increasing_id()))
    return numbered.withColumns(
        {CELL: F.shiftright("_place", 33).cast("int"), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)}
    )


def with_previous(
    df: DataFrame, entity: str | Sequence[str], time: str, values: Sequence[str], scan: bool = False
) -> DataFrame:
    """Add ``_previous`` (struct of the row before, NULL at the first row) and ``_start`` (first time).

    Rows without a time have no place in the order and are dropped. ``entity=[]`` treats the whole frame as
    one series.
    """
    keys = entity_columns(entity)
    rows = df.filter(F.col(time).isNotNull())
    repeated = F.raise_error(F.concat(F.lit("the panel key repeats at "), F.col(time).cast("string")))
    checked = F.when(F.col(f"_previous.{time}") == F.col(time), repeated).otherwise(F.col("_previous"))
    state = F.struct(time, *[v for v in values if v != time])
    if bounded_by_calendar(df, time, scan):
        order = Window.partitionBy(*keys).orderBy(time)
        return rows.withColumns({"_previous": F.lag(state).over(order), START: F.first(time).over(order)}).withColumn(
            "_previous", checked
        )
    rows = range_cells(rows, [*keys, time]).drop("_place")
    edges = rows.groupBy(*keys, CELL).agg(F.max_by(state, time).alias(STATE), F.min(time).alias(START))
    over_cells = Window.partitionBy(*keys).orderBy(CELL)
    carry = edges.select(
        *keys, CELL, F.lit(0).alias(ROLE), F.lag(STATE).over(over_cells).alias(STATE), F.first(START).over(over_cells).alias(START)
    ).filter(F.col(STATE).isNotNull())
    stacked = rows.withColumns({ROLE: F.lit(1), STATE: state}).unionByName(carry, allowMissingColumns=True)
    in_cell = Window.partitionBy(*keys, CELL).orderBy(ROLE, time)
    return (
        stacked.withColumns(
            {"_previous": F.lag(STATE).over(in_cell), START: F.first(F.coalesce(START, time)).over(in_cell)}
        )
        .filter(F.col(ROLE) == 1)
        .drop(CELL, ROLE, STATE)
        .withColumn("_previous", checked)
    )


def change(column: str, previous: str = "_previous") -> Column:
    """Change against the row before; the first row keeps its full value, a missing level stays missing."""
    return F.col(column) - F.when(F.col(previous).isNull(), F.lit(0)).otherwise(F.col(f"{previous}.{column}"))


def exposure_days(time: str, start: str = START) -> Column:
    """1-based number of days since the entity's first record."""
    return F.datediff(F.col(time), F.col(start)) + 1


def deltas(
    df: DataFrame,
    entity: str | Sequence[str],
    time: str,
    measures: Mapping[str, str],
    exposure: str | None = None,
    scan: bool = False,
) -> DataFrame:
    """``{new column: cumulative column}`` per-step changes and, if named, the exposure day."""
    rows = with_previous(df, entity, time, list(measures.values()), scan)
    added = {new: change(level) for new, level in measures.items()}
    if exposure:
        added[exposure] = exposure_days(time)
    return rows.withColumns(added).drop("_previous", START)


def series_deltas(df: DataFrame, time: str, measures: Mapping[str, str], scan: bool = False) -> DataFrame:
    """Changes along one series without entities, such as daily totals."""
    return deltas(df, [], time, measures, scan=scan)


def running_totals(
    df: DataFrame, entity: str | Sequence[str], time: str, measures: Mapping[str, str], scan: bool = False
) -> DataFrame:
    """``{new column: column}`` cumulative sums, the inverse of :func:`deltas`, cut the same way."""
    keys = entity_columns(entity)
    rows = df.filter(F.col(time).isNotNull())
    if bounded_by_calendar(df, time, scan):
        order = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(m).over(order) for n, m in measures.items()})
    rows = range_cells(rows, [*keys, time]).drop("_place")
    over_cells = Window.partitionBy(*keys).orderBy(CELL)
    before = over_cells.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, CELL)
        .agg(*[F.sum(m).alias(m) for m in set(measures.values())])
        .select(
            *keys, CELL, F.lit(0).alias(ROLE), F.row_number().over(over_cells).alias("_k"),
            *[F.sum(m).over(before).alias(n) for n, m in measures.items()],
        )
        .filter(F.col("_k") > 1)
        .drop("_k")
    )
    stacked = rows.withColumns({ROLE: F.lit(1), **{n: F.col(m) for n, m in measures.items()}}).unionByName(
        carry, allowMissingColumns=True
    )
    in_cell = Window.partitionBy(*keys, CELL).orderBy(ROLE, time).rowsBetween(Window.unboundedPreceding, 0)
    return (
        stacked.withColumns({n: F.sum(n).over(in_cell) for n in measures})
        .filter(F.col(ROLE) == 1)
        .drop(CELL, ROLE)
    )


def attach_group_max(df: DataFrame, entity: str, columns: Mapping[str, str]) -> DataFrame:
    """``{new column: column}`` group maxima on every row: aggregate, then join back."""
    top = df.groupBy(entity).agg(*[F.max(c).alias(n) for n, c in columns.items()])
    return left_join(df, top, entity)


def recent_n(df: DataFrame, entity: str, order: str, n: int, unique: bool = False) -> DataFrame:
    """The ``n`` rows with the largest ``order`` per entity, **ties at the limit kept**.

    With ``unique`` the caller says that (entity, order) does not repeat, as on a panel: then a rank does it in one
    pass, and Spark keeps ``n`` rows per entity and task before the shuffle. Without it a value may repeat any
    number of times, and rows are never gathered per entity. Counts per distinct (entity, order) value give, for each entity, the
    value at which the ``n``-th row sits; rows at or above it stay. A value repeated any number of times is one
    counted row on the way.
    """
    value = F.col(order)
    if unique:
        place = F.rank().over(Window.partitionBy(entity).orderBy(value.desc()))
        return df.filter(value.isNotNull()).withColumn("_r", place).filter(F.col("_r") <= n).drop("_r")
    counts = df.filter(value.isNotNull()).groupBy(entity, order).agg(F.count(F.lit(1)).alias("_c"))
    down = Window.partitionBy(entity).orderBy(value.desc())
    before = F.sum("_c").over(down.rowsBetween(Window.unboundedPreceding, -1))
    limits = (
        counts.withColumn("_r", F.row_number().over(down))
        .filter(F.col("_r") <= n)
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .filter(F.col("_before") < n)
        .groupBy(F.col(entity).alias("_e"))
        .agg(F.min(order).alias("_limit"))
    )
    return df.join(limits, F.col(entity).eqNullSafe(F.col("_e")) & (value >= F.col("_limit")), "left_semi")


def latest_rows(df: DataFrame, time: str) -> DataFrame:
    """Rows at the last time of the whole frame; the maximum is a scalar subquery the scan can filter on."""
    return df.filter(F.col(time) == df.agg(F.max(time)).scalar())


def before_latest(df: DataFrame, time: str) -> DataFrame:
    return df.filter(F.col(time) != df.agg(F.max(time)).scalar())


def _p_bucket(p: Column) -> Column:
    """Monotone cut of [0, 1] into a few thousand cells, fine near 0 where adjusted tests crowd."""
    fine = F.lit(4096) - F.least(F.floor(F.lit(-256.0) * (F.log2(p) + F.lit(8.0))), F.lit(300_000))
    return F.when(p <= 0, F.lit(-400_000)).when(p < 2.0**-8, fine).otherwise(4097 + F.floor(p * 65536)).cast("long")


def holm(df: DataFrame, p: str, adjusted: str = "adjusted") -> DataFrame:
    """Holm step-down adjustment over the whole frame, without sorting it in one task.

    Equal p-values get equal adjustments, so only the distinct p-values with their counts are ordered. They are
    cut into value cells; a window over the cell summaries (a bounded table) hands each cell the number of
    smaller p-values and a window per cell does the rest.
    """
    counts = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(F.col(p).cast("double").alias("_p")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    cells = counts.withColumn("_cell", _p_bucket(F.col("_p")))
    below = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("_cell").agg(F.sum("_c").alias("_n"))
    offsets = sizes.select(
        "_cell",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_cell").orderBy("_p")
    smaller = F.col("_offset") + F.coalesce(
        F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    raw = (
        cells.join(offsets, "_cell")
        .withColumn("_raw", (F.col("_total") - smaller) * F.col("_p"))
        .withColumn("_raw", F.max("_raw").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    tops = raw.groupBy("_cell").agg(F.max("_raw").alias("_top"))
    floors = tops.select("_cell", F.max("_top").over(below).alias("_floor"))
    steps = raw.join(floors, "_cell").select(
        F.col("_p"), F.least(F.lit(1.0), F.greatest("_raw", "_floor")).alias(adjusted)
    )
    return df.join(steps, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")


def ranked(df: DataFrame, value: str, ties: Sequence[str] = (), rank: str = "rank", total: str = "total") -> DataFrame:
    """``df`` with the exact rank of every row by ``value`` from 1 on, and the number of ranked rows.

    Ties are ranked by the columns ``ties``, then in the order of the rows; a value may be repeated any number of times.
    Rows with a missing value or NaN have no rank and are left out. One range shuffle; the only table that meets in one
    task has a row for each cell.
    """
    there = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        there = there & ~F.isnan(value)
    # The row's number makes every place in the order its own, so equal values can lie in several cells.
    rows = df.filter(there).withColumn("_row", F.monotonically_increasing_id())
    rows = range_cells(rows, [value, *ties, "_row"])
    over_cells = Window.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(CELL).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        F.col(CELL).alias("_c"),
        F.coalesce(F.sum("_n").over(over_cells), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias(total),
    )
    # As many rows as there are shuffle partitions.
    joined = rows.join(F.broadcast(offsets), F.col(CELL) == F.col("_c"))
    return joined.withColumn(rank, F.col("_before") + F.col("_place") + 1).drop("_before", "_place", "_c", "_row", CELL)


def qq_points(df: DataFrame, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """One point per row: its probability ``p`` and the normal quantile ``theoretical`` to hold ``value`` against.

    The i-th smallest of n values stands at (i - a) / (n + 1 - 2 a) with a = 3/8 up to ten values and 1/2 beyond.
    Ties and missing values as in :func:`ranked`.
    """
    rows = ranked(df, value, ties, "_rank", "_total")
    a = F.when(F.col("_total") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    rows = rows.withColumn("p", (F.col("_rank") - a) / (F.col("_total") + 1 - 2 * a))
    return rows.withColumn("theoretical", normal_quantile_column(F.col("p"))).drop("_rank", "_total")
