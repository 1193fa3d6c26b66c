"""Equi joins with the missing-key and name-clash rules of the data-frame verbs they stand for.

No join here hints a broadcast: the sides are tables that may grow, so the choice is left to Spark, which
broadcasts a side only when its measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
sort-merges, splitting skewed partitions of the left side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str] | Mapping[str, str]


def key_pairs(on: Keys) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(k, k) for k in on]


def left_join(
    left: DataFrame, right: DataFrame, on: Keys, suffixes: tuple[str, str] = ("_x", "_y"), null_keys: bool = True
) -> DataFrame:
    """Left equi join on equally or differently named keys (``{"left": "right"}``).

    Missing keys match each other unless ``null_keys=False``. Other columns present on both sides get the
    suffixes, so joining the same table twice works.
    """
    pairs = key_pairs(on)
    right_keys = {r: f"_key{i}" for i, (_, r) in enumerate(pairs)}
    clash = (set(left.columns) - {l for l, _ in pairs}) & (set(right.columns) - set(right_keys))
    clash |= {c for c in right.columns if c not in right_keys and c in {l for l, _ in pairs}}
    keep = {l for l, _ in pairs}
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash if c not in keep})
    right = right.withColumnsRenamed({**right_keys, **{c: c + suffixes[1] for c in clash}})
    tests = [
        F.col(l).eqNullSafe(F.col(right_keys[r])) if null_keys else F.col(l) == F.col(right_keys[r])
        for l, r in pairs
    ]
    return left.join(right, reduce(lambda a, b: a & b, tests), "left").drop(*right_keys.values())


def outer_merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of any number of tables that are each unique on ``keys`` and share no other column.

    A chain of outer joins needs one shuffle per join and cannot split a skewed key. Stacking the tables and
    grouping once gives the same rows with one shuffle and a map-side combine. A key that repeats inside one
    table would multiply rows in an outer join; here it stops the job with an error.
    """
    measures: list[str] = []
    for table in tables:
        measures.extend(c for c in table.columns if c not in keys)
    if len(set(measures)) != len(measures):
        raise ValueError("tables to merge may share their keys only; rename the other columns first")
    tagged = [
        t.select(*keys, *[c for c in t.columns if c not in keys], F.lit(i).alias("_table"))
        for i, t in enumerate(tables)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    counts = [F.sum((F.col("_table") == i).cast("int")).alias(f"_n{i}") for i in range(len(tables))]
    merged = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in measures], *counts)
    repeats = F.greatest(*[F.col(f"_n{i}") for i in range(len(tables))]) if len(tables) > 1 else F.col("_n0")
    once = F.when(repeats > 1, F.raise_error(F.lit("outer_merge: a key repeats within one table"))).otherwise(True)
    return merged.filter(once).select(*keys, *measures)


def full_join(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """Full outer join with merged keys, for sides that may repeat a key (rows then multiply). Missing keys match
    each other, as in the other joins."""
    pairs = key_pairs(on)
    names = [l for l, _ in pairs]
    right = right.withColumnsRenamed({r: f"_right_{l}" for l, r in pairs})
    same = reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[f"_right_{l}"]) for l in names])
    joined = left.join(right, same, "outer")
    merged = [F.coalesce(F.col(f"`{l}`"), F.col(f"`_right_{l}`")).alias(l) for l in names]
    rest = [F.col(f"`{c}`") for c in [*left.columns, *right.columns] if c not in names and not c.startswith("_right_")]
    return joined.select(*merged, *rest)


def geo_join(features: DataFrame, metrics: DataFrame, name: str, entity: str, metric: str) -> DataFrame:
    """Every map feature with one chosen metric of the entity it shows; unknown areas keep NULL."""
    side = metrics.select(F.col(entity).alias("_entity"), F.col(metric).alias("value"))
    return (
        features.join(side, F.col(name) == F.col("_entity"), "left")
        .withColumn("metric", F.lit(metric))
        .drop("_entity")
    )
