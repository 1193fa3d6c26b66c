"""Entity names: recoding, membership and coverage reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


def compose_rules(rules: Rules) -> dict[str, str]:
    """Collapse rules that run one after the other into one map: a->b, b->c gives a->c and b->c."""
    final = {}
    for start, _ in rules:
        value = start
        for old, new in rules:
            if value == old:
                value = new
        final[start] = value
    return final


def recode(df: DataFrame, column: str, rules: Rules, into: str | None = None) -> DataFrame:
    """Exact-match replacement by a short rule list held in the plan; other values stay.

    The lookup is a literal map, so there is neither a join nor a shuffle. Long mappings belong in a table:
    see :func:`recode_from`.
    """
    table = compose_rules(rules)
    if not table:
        return df.withColumn(into or column, F.col(column))
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return df.withColumn(into or column, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def recode_from(
    df: DataFrame, column: str, mapping: DataFrame, source: str, target: str, into: str | None = None
) -> DataFrame:
    """Recode through a mapping table with one row per source value; a repeated one stops the job."""
    side = mapping.groupBy(F.col(source).alias("_from")).agg(F.max(target).alias("_to"), F.count("*").alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("recode_from: a source value repeats")).cast("boolean"))
    side = side.filter(once.otherwise(True)).drop("_n")
    joined = df.join(side, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(into or column, F.coalesce("_to", column)).drop("_from", "_to")


def keep_entities(df: DataFrame, key: str, allowed: DataFrame | Iterable[str]) -> DataFrame:
    """Rows whose key occurs in a list, or in the first column of another frame."""
    if not isinstance(allowed, DataFrame):
        return df.filter(F.col(key).isin(list(allowed)))
    side = allowed.select(F.col(allowed.columns[0]).alias("_allowed")).distinct()
    return df.join(side, F.col(key).eqNullSafe(F.col("_allowed")), "left_semi")


def without_entities(df: DataFrame, key: str, banned: Iterable[str]) -> DataFrame:
    return df.filter(~F.col(key).isin(list(banned)))


def unmatched_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Distinct left keys the right side does not know."""
    return left.select(left_key).subtract(right.select(F.col(right_key or left_key).alias(left_key)))


def shared_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    return left.select(left_key).intersect(right.select(F.col(right_key or left_key).alias(left_key)))


def key_coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """One row per key with its row count on each side and ``left_only`` / ``right_only`` / ``both``.

    Both sides are counted in one aggregate, so only partial counts travel and a hot key stays cheap.
    """
    sides = (
        left.select(F.col(left_key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionAll(right.select(F.col(right_key or left_key).alias("key"), F.lit(0), F.lit(1)))
        .groupBy("key")
        .agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    )
    status = (
        F.when(F.col("right_rows") == 0, "left_only").when(F.col("left_rows") == 0, "right_only").otherwise("both")
    )
    return sides.withColumn("status", status)


def check_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count: empty when the key holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
