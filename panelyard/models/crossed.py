"""Mixed models whose two factors cross: ``(1 + random | entity) + (1 + random | outer)`` with entities in several
outer groups.

Sums of products per pair of entity and outer group are all that the data is read for. The factor with more levels is
eliminated level by level, as in the one-level fit: each level adds to one matrix over the columns of the other factor,
the fixed terms and the response. These matrices are added up over the cluster; the other factor is then eliminated from
the sum on the driver. Its columns (levels times random terms) are limited to ``MOST_COLUMNS``, which bounds the matrix
and the pairs of one level, whatever the number of rows or of levels of the larger factor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.models import design as d
from panelyard.models.design import unpack
from panelyard.models.lmm import SUMS, Criterion, MixedModel, Structure, absorb, factor, minimise, start_theta
from panelyard.session import cut_lineage

#: Most columns of the factor with fewer levels: a matrix of 600 columns is three megabytes.
MOST_COLUMNS = 600


@dataclass
class Pairs:
    """One row per level of the larger factor (``fine``): places of the levels of the other one, and sums with each."""

    rows: DataFrame
    fine: str
    coarse: str
    labels: list
    shape: Structure

    @property
    def columns(self) -> int:
        return len(self.labels) * self.shape.r


def _pairs(groups: DataFrame, shape: Structure, entity: str, outer: str) -> Pairs:
    levels = groups.agg(F.count_distinct(entity).alias("e"), F.count_distinct(outer).alias("o")).first()
    fine, coarse = (entity, outer) if levels["e"] >= levels["o"] else (outer, entity)
    if min(levels["e"], levels["o"]) * shape.r > MOST_COLUMNS:
        raise ValueError(f"{coarse} has too many levels for a crossed fit: {MOST_COLUMNS} columns at most")
    named = groups.select(coarse).distinct().orderBy(coarse)
    labels = [r[0] for r in named.collect()]
    kind = groups.schema[coarse].dataType.simpleString()
    places = groups.sparkSession.createDataFrame(list(enumerate(labels)), f"_place int, _label {kind}")
    numbered = groups.join(F.broadcast(places), F.col(coarse).eqNullSafe(F.col("_label")))
    listed = numbered.groupBy(fine).agg(
        F.collect_list("_place").alias("_places"), F.flatten(F.collect_list(SUMS)).alias(SUMS)
    )
    # Both lists are filled row by row, so they agree in order.
    return Pairs(cut_lineage(listed), fine, coarse, labels, shape)


def _level(shape: Structure, places: np.ndarray, packed: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns a level touches, their sums of products, and those with the level's own random columns."""
    z, r, width = shape.z, shape.r, shape.width
    sums = unpack(packed.reshape(len(places), -1), width)
    at = np.concatenate([(places[:, None] * r + np.arange(r)).ravel(), columns + np.arange(width)])
    many = len(places) * r
    own = np.zeros((many + width, many + width))
    for k in range(len(places)):
        block = slice(k * r, (k + 1) * r)
        own[block, block] = sums[k][np.ix_(z, z)]
        own[block, many:] = sums[k][z]
        own[many:, block] = sums[k][z].T
    own[many:, many:] = sums.sum(0)
    with_level = np.concatenate([own[:many, many:][:, z].T, own[many:, many:][z]], axis=1)
    return at, own, with_level


def _solve_level(lower: np.ndarray, z: Sequence[int], with_level: np.ndarray, many: int) -> tuple[np.ndarray, float]:
    szz = with_level[:, many:][:, z]
    b = lower.T @ szz @ lower + np.eye(len(lower))
    return lower @ np.linalg.solve(b, lower.T), np.linalg.slogdet(b)[1]


def reduced(pairs: Pairs, lowers: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """(sum of log-determinants, matrix over the other factor's columns, terms and response) for every factor of the
    larger factor's effects, in one job."""
    shape, columns = pairs.shape, pairs.columns
    size = columns + shape.width

    def run(batches):
        total, logdet = np.zeros((len(lowers), size, size)), np.zeros(len(lowers))
        for batch in batches:
            for places, packed in zip(batch["_places"], batch[SUMS], strict=True):
                at, own, with_level = _level(shape, np.asarray(places), np.asarray(packed), columns)
                many = len(places) * shape.r
                grid = np.ix_(at, at)
                for i, lower in enumerate(lowers):
                    k, part = _solve_level(lower, shape.z, with_level, many)
                    total[i][grid] += own - with_level.T @ k @ with_level
                    logdet[i] += part
        for i in range(len(lowers)):
            yield pd.DataFrame({"k": i, "i": range(size), "logdet": [logdet[i], *[0.0] * (size - 1)], "line": list(total[i])})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        line = np.sum(np.stack(part["line"].to_numpy()), axis=0)
        return pd.DataFrame({"k": part["k"][:1], "i": part["i"][:1], "logdet": [part["logdet"].sum()], "line": [line]})

    kind = "k int, i int, logdet double, line array<double>"
    lines = pairs.rows.select("_places", SUMS).mapInPandas(run, kind).groupBy("k", "i").applyInPandas(add, kind)
    total, logdet = np.zeros((len(lowers), size, size)), np.zeros(len(lowers))
    for row in lines.collect():
        total[row["k"], row["i"]] = row["line"]
        logdet[row["k"]] += row["logdet"]
    return list(zip(logdet, total, strict=True))


@dataclass
class CrossedSearch:
    """The criterion of stacks of candidates: the entity's factor first, then the outer group's."""

    pairs: Pairs
    rule: Criterion
    entity_is_fine: bool
    calls: int = 0
    seen: dict = field(default_factory=dict)

    def split(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the larger and of the smaller factor."""
        m = self.pairs.shape.per_level
        return (theta[:m], theta[m:]) if self.entity_is_fine else (theta[m:], theta[:m])

    def matrices(self, thetas: np.ndarray) -> None:
        new = {fine.tobytes(): fine for fine, _ in map(self.split, thetas) if fine.tobytes() not in self.seen}
        if new:
            self.calls += 1
            found = reduced(self.pairs, [factor(t, self.pairs.shape.r) for t in new.values()])
            self.seen |= dict(zip(new, found, strict=True))

    def eliminated(self, theta: np.ndarray):
        """(log-determinant, sums left of terms and response, K of the smaller factor, matrix before)."""
        fine, coarse = self.split(theta)
        logdet, whole = self.seen[fine.tobytes()]
        lower = np.kron(np.eye(len(self.pairs.labels)), factor(coarse, self.pairs.shape.r))
        left, k, more = absorb(whole[None], range(self.pairs.columns), lower)
        q = self.pairs.columns
        return logdet + more[0], left[0][q:, q:], k[0], whole

    def __call__(self, thetas: np.ndarray) -> np.ndarray:
        self.matrices(thetas)
        return np.array([self.rule.value(*self.eliminated(t)[:2]) for t in thetas])


@dataclass
class CrossedModel(MixedModel):
    """A fitted model of two crossed factors. It predicts and lists its effects like a nested one; predictive standard
    deviations are not defined for it, and it is not stored."""

    fine_effects: DataFrame | None = None
    coarse_effects: DataFrame | None = None
    entity_is_fine: bool = True

    @property
    def effect_keys(self) -> list[str]:
        return [self.entity]

    def effects(self) -> DataFrame:
        return self.fine_effects if self.entity_is_fine else self.coarse_effects

    def outer_effects(self) -> DataFrame:
        return self.coarse_effects if self.entity_is_fine else self.fine_effects


def fit_crossed(
    groups: DataFrame, shape: Structure, n: int, terms: list[str], random: list[str], entity: str, outer: str,
    scales: d.Scales, response: str, max_steps: int, common: dict,
) -> CrossedModel:
    pairs = _pairs(groups, shape, entity, outer)
    search = CrossedSearch(pairs, Criterion(n), pairs.fine == entity)
    theta, value, converged = minimise(search, np.concatenate([start_theta(shape.r)] * 2), max_steps)
    search.matrices(theta[None])
    logdet, left, k, whole = search.eliminated(theta)
    value, beta, inverse, s2 = search.rule.parts(logdet, left)
    value += 2 * sum(np.log(scales.scale)) + (n - len(beta)) * 2 * np.log(scales.y_scale)
    q, p = pairs.columns, shape.width - 1
    coarse = (k @ (whole[:q, q + p] - whole[:q, q : q + p] @ beta)).reshape(-1, shape.r)
    spark, kind = groups.sparkSession, {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    counts = groups.groupBy(pairs.coarse).agg(F.sum(F.col(SUMS)[0]).alias("n"))
    named = spark.createDataFrame(
        [(label, u.tolist()) for label, u in zip(pairs.labels, coarse, strict=True)], f"_label {kind[pairs.coarse]}, u array<double>"
    )
    coarse_effects = counts.join(F.broadcast(named), F.col(pairs.coarse).eqNullSafe(F.col("_label"))).drop("_label")
    lower, fine = factor(search.split(theta)[0], shape.r), pairs.fine

    def solve(batches):
        for batch in batches:
            effects, sizes = [], []
            for places, packed in zip(batch["_places"], batch[SUMS], strict=True):
                places = np.asarray(places)
                _, own, with_level = _level(shape, places, np.asarray(packed), q)
                many = len(places) * shape.r
                inner, _ = _solve_level(lower, shape.z, with_level, many)
                rest = with_level[:, many + p] - with_level[:, many : many + p] @ beta - with_level[:, :many] @ coarse[places].ravel()
                effects.append(inner @ rest)
                sizes.append(own[many, many])
            yield pd.DataFrame({fine: batch[fine], "n": sizes, "u": effects})

    fine_effects = pairs.rows.mapInPandas(solve, f"`{fine}` {kind[fine]}, n double, u array<double>")
    return CrossedModel(
        terms, random, entity, outer, scales, shape, theta, beta, inverse, float(s2), n, float(value), converged,
        search.calls, groups, response, **common, fine_effects=fine_effects, coarse_effects=coarse_effects,
        entity_is_fine=pairs.fine == entity,
    )
