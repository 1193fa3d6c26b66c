"""Linear mixed models with random intercept and slopes, one level or two nested levels.

The data is read twice: once for the column scales and once for the sums of products per group. Everything after
that works on one small row per group. For a candidate relative covariance factor L of the random effects each
group contributes

    B = L' Szz L + I,   K = L B^-1 L',   C = S - S.z K Sz.,   log|B|

and the sums of C and log|B| over all groups give the profiled REML criterion. Candidates are tried several at a
time (a quasi-Newton step and its difference quotients), so a step of the optimiser is one Spark job over the
group table that returns a few sums. With two levels C is summed per outer group first and the same step runs on
those sums.

Terms that are constant or a combination of earlier ones are found once, from the sums over all groups, and left out
of every candidate. Effects of two factors of which neither nests in the other are in ``crossed``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.models import design as d
from panelyard.models.design import pack, unpack
from panelyard.session import cut_lineage

SUMS = "_s"


def factor(theta: np.ndarray, r: int) -> np.ndarray:
    """Lower-triangular factor from its r*(r+1)/2 entries, column by column."""
    lower = np.zeros((r, r))
    cols, rows = np.triu_indices(r)
    lower[rows, cols] = theta
    return lower


def start_theta(r: int) -> np.ndarray:
    cols, rows = np.triu_indices(r)
    return (rows == cols).astype(float)


def absorb(cross: np.ndarray, z: Sequence[int], lower: np.ndarray):
    """Integrate random effects out of a stack of cross-product matrices: (C, K, log|B|) per group."""
    z = list(z)
    szz = cross[:, z][:, :, z]
    b = lower.T @ szz @ lower + np.eye(len(z))
    k = lower @ np.linalg.solve(b, np.broadcast_to(lower.T, b.shape).copy())
    sz = cross[:, z, :]
    reduced = cross - np.swapaxes(sz, 1, 2) @ (k @ sz)
    return reduced, k, np.linalg.slogdet(b)[1]


@dataclass
class Structure:
    """Column places of a fitted design: intercept, terms, response; ``z`` are the random columns."""

    width: int
    z: list[int]
    levels: int = 1

    @property
    def r(self) -> int:
        return len(self.z)

    @property
    def per_level(self) -> int:
        return self.r * (self.r + 1) // 2

    def lowers(self, theta: np.ndarray) -> list[np.ndarray]:
        m = self.per_level
        return [factor(theta[i * m : (i + 1) * m], self.r) for i in range(self.levels)]


def _sum_columns(width: int) -> list[str]:
    return [f"c{i}" for i in range(width * (width + 1) // 2)]


def evaluate(groups: DataFrame, shape: Structure, thetas: np.ndarray, outer: str | None) -> list[tuple[float, np.ndarray]]:
    """(sum of log-determinants, summed C) for every candidate, in one job."""
    width, z, names = shape.width, shape.z, _sum_columns(shape.width)
    lowers = [shape.lowers(t) for t in thetas]
    kind = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    sums = ", ".join(f"{c} double" for c in names)

    def one_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(lowers), 1 + len(names)))
        for batch in batches:
            if batch.empty:
                continue
            cross = unpack(np.stack(batch[SUMS].to_numpy()), width)
            for i, level in enumerate(lowers):
                reduced, _, logdet = absorb(cross, z, level[0])
                total[i, 0] += logdet.sum()
                total[i, 1:] += pack(reduced.sum(0))
        out = pd.DataFrame(total, columns=["logdet", *names])
        out.insert(0, "k", range(len(lowers)))
        yield out

    def inner_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            cross = unpack(np.stack(batch[SUMS].to_numpy()), width)
            codes, labels = pd.factorize(batch[outer], use_na_sentinel=False)
            for i, level in enumerate(lowers):
                reduced, _, logdet = absorb(cross, z, level[0])
                total = np.zeros((len(labels), 1 + len(names)))
                np.add.at(total, codes, np.column_stack([logdet, pack(reduced)]))
                out = pd.DataFrame(total, columns=["logdet", *names])
                out.insert(0, "k", i)
                out.insert(1, outer, labels)
                yield out

    def outer_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(lowers), 1 + len(names)))
        for batch in batches:
            for i, part in batch.groupby("k"):
                cross = unpack(part[names].to_numpy(), width)
                reduced, _, logdet = absorb(cross, z, lowers[i][1])
                total[i, 0] += logdet.sum() + part["logdet"].sum()
                total[i, 1:] += pack(reduced.sum(0))
        out = pd.DataFrame(total, columns=["logdet", *names])
        out.insert(0, "k", range(len(lowers)))
        yield out

    add = [F.sum(c).alias(c) for c in ["logdet", *names]]
    if shape.levels == 1:
        parts = groups.select(SUMS).mapInPandas(one_level, f"k int, logdet double, {sums}")
    else:
        inner = groups.select(outer, SUMS).mapInPandas(inner_level, f"k int, `{outer}` {kind[outer]}, logdet double, {sums}")
        parts = inner.groupBy("k", outer).agg(*add).mapInPandas(outer_level, f"k int, logdet double, {sums}")
    parts = parts.groupBy("k").agg(*add)
    total = np.zeros((len(lowers), 1 + len(names)))
    for row in parts.select("k", "logdet", *names).collect():
        total[row[0]] += row[1:]
    return [(t[0], unpack(t[None, 1:], width)[0]) for t in total]


@dataclass
class Criterion:
    """REML (profiled residual variance) or, with ``unit_scale``, maximum likelihood at residual variance 1."""

    n: float
    unit_scale: bool = False

    def parts(self, logdet: float, c: np.ndarray):
        xx, xy, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
        inverse = np.linalg.pinv(xx, hermitian=True)
        beta = inverse @ xy
        rss = max(float(yy - beta @ xy), 1e-300)
        if self.unit_scale:
            return logdet + rss, beta, inverse, 1.0
        free = self.n - len(beta)
        s2 = rss / free
        return logdet + np.linalg.slogdet(xx)[1] + free * (1 + np.log(2 * np.pi * s2)), beta, inverse, s2

    def value(self, logdet: float, c: np.ndarray) -> float:
        return self.parts(logdet, c)[0]


class Search:
    """The criterion as a function of many candidates at once, remembering the sums of every answer."""

    def __init__(self, groups: DataFrame, shape: Structure, rule: Criterion, outer: str | None = None):
        self.groups, self.shape, self.rule, self.outer = groups, shape, rule, outer
        self.calls, self.seen = 0, {}

    def __call__(self, thetas: np.ndarray) -> np.ndarray:
        self.calls += 1
        answers = evaluate(self.groups, self.shape, thetas, self.outer)
        self.seen = {t.tobytes(): part for t, part in zip(thetas, answers)} | self.seen
        return np.array([self.rule.value(*part) for part in answers])

    def parts(self, theta: np.ndarray):
        if theta.tobytes() not in self.seen:
            self(theta[None, :])
        return self.rule.parts(*self.seen[theta.tobytes()])


def stencil(t: np.ndarray) -> tuple[np.ndarray, float]:
    """Points around ``t`` for first and second derivatives, and their distance."""
    m = len(t)
    unit = np.eye(m)
    both = [unit[i] + unit[j] for i in range(m) for j in range(i)]
    h = 5e-4 * max(np.max(np.abs(t)), 1e-3)
    return t + h * np.array([np.zeros(m), *unit, *-unit, *both, *[-b for b in both]]), h


def derivatives(f: np.ndarray, h: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature from the values on a stencil."""
    up, down = f[1 : m + 1], f[m + 1 : 2 * m + 1]
    second = np.diag((up - 2 * f[0] + down) / h**2)
    both = f[2 * m + 1 :].reshape(2, -1)
    for k, (i, j) in enumerate((i, j) for i in range(m) for j in range(i)):
        mixed = (both[0, k] + both[1, k] + 2 * f[0] - up[i] - up[j] - down[i] - down[j]) / (2 * h**2)
        second[i, j] = second[j, i] = mixed
    return (up - down) / (2 * h), second


def minimise(
    search: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, max_steps: int = 25, scan: bool = True,
    tolerance: float = 1e-10,
) -> tuple[np.ndarray, float, bool]:
    """Newton search with derivatives by differences. ``search`` answers a stack of candidates in one call, so a
    step asks for the full step with its differences and for shorter and longer steps together. ``scan`` tries the
    starting point at several scales first. Returns (theta, value, converged)."""
    m = len(theta)
    lengths = np.array([0.5, 0.25, 0.1, 0.02, 2.0])
    if scan:
        scales = np.array([1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 3.0])
        theta = theta * scales[int(np.nanargmin(search(scales[:, None] * theta)))]
    points, h = stencil(theta)
    answers = search(points)
    value, (slope, curve) = answers[0], derivatives(answers, h, m)
    for _ in range(max_steps):
        w, v = np.linalg.eigh(curve)
        w = np.maximum(np.abs(w), 1e-10 * np.max(np.abs(w)) + 1e-300)
        step = -v @ ((v.T @ slope) / w)
        gain = -slope @ step / 2
        if not gain > tolerance + 1e-13 * abs(value):
            return theta, value, True
        points, h = stencil(theta + step)
        answers = search(np.vstack([points, theta + lengths[:, None] * step]))
        near, far = answers[: len(points)], answers[len(points) :]
        if near[0] < value - 0.1 * gain:
            theta, value, (slope, curve) = points[0], near[0], derivatives(near, h, m)
            continue
        best = int(np.nanargmin(far))
        if not far[best] < value:
            if near[0] < value:
                return points[0], near[0], True
            return theta, value, gain < 1e-3
        theta, value = theta + lengths[best] * step, far[best]
        points, h = stencil(theta)
        answers = search(points)
        slope, curve = derivatives(answers, h, m)
    return theta, value, False


@dataclass
class MixedModel:
    """A fitted mixed model. Arrays are in scaled units; the methods give raw units."""

    terms: list[str]
    random: list[str]
    entity: str
    outer: str | None
    scales: d.Scales
    shape: Structure
    theta: np.ndarray
    beta: np.ndarray
    inverse: np.ndarray
    s2: float
    n: int
    criterion: float
    converged: bool
    calls: int
    groups: DataFrame
    response: str
    family: str = "gaussian"
    extra: dict = field(default_factory=dict)
    #: Terms as given, and those of them that the others make superfluous; ``terms`` are the fitted ones.
    given: list[str] | None = None
    aliased: list[str] = field(default_factory=list)
    _effects: DataFrame | None = None
    _outer_effects: DataFrame | None = None

    @property
    def spark(self):
        return self.groups.sparkSession

    def coefficients(self) -> DataFrame:
        """Estimate, standard error, statistic, normal p-value and bounds two standard errors away; all missing for an
        aliased term."""
        from panelyard.functions.distributions import normal_two_sided
        from panelyard.models.ols import coefficient_frame

        t = self.scales.back()
        beta = t @ self.beta
        beta[0] += self.scales.y_shift
        error = np.sqrt(np.diag(t @ self.inverse @ t.T) * self.s2)
        z = beta / error
        columns = [beta, error, z, [normal_two_sided(v) for v in z]]
        names = [d.INTERCEPT, *(self.given or self.terms)]
        place = {name: i for i, name in enumerate([d.INTERCEPT, *self.terms])}
        return coefficient_frame(self.spark, names, *[[c[place[n]] if n in place else None for n in names] for c in columns])

    def _z_back(self) -> np.ndarray:
        return self.scales.back()[np.ix_(self.shape.z, self.shape.z)]

    def random_covariance(self) -> list[np.ndarray]:
        """Covariance of the random effects in raw units, innermost level first."""
        t = self._z_back()
        return [t @ (l @ l.T) @ t.T * self.s2 for l in self.shape.lowers(self.theta)]

    def residual_variance(self) -> float:
        return float(self.s2 * self.scales.y_scale**2)

    @property
    def effect_keys(self) -> list[str]:
        """What an entity's effects are found by."""
        return [self.entity] + ([self.outer] if self.outer else [])

    def effects(self) -> DataFrame:
        """Per entity: effects ``u`` and the matrices ``K``, ``W``, ``H`` that predictive variances need."""
        if self._effects is None:
            self._effects = inner_effects(self)
        return self._effects

    def outer_effects(self) -> DataFrame | None:
        if self.outer is not None and self._outer_effects is None:
            self._outer_effects = outer_effects(self)
        return self._outer_effects

    def group_effects(self) -> DataFrame:
        """Random effects of every entity in raw units, one column per random term."""
        t = self._z_back()
        names = [d.INTERCEPT, *self.random]
        columns = [
            sum((F.lit(float(t[i, j])) * F.col("u")[j] for j in range(len(names))), F.lit(0.0)).alias(n)
            for i, n in enumerate(names)
        ]
        return self.effects().select(*self.effect_keys, "n", *columns)


def _effect_schema(keys: Sequence[str], kind: dict[str, str]) -> str:
    names = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    return f"{names}, n double, u array<double>, K array<double>, W array<double>, H array<double>"


def _effect_rows(batch, keys, n, u, k, w, h) -> pd.DataFrame:
    out = {key: batch[key].to_numpy() for key in keys}
    out["n"] = n
    for name, value in (("u", u), ("K", k), ("W", w), ("H", h)):
        out[name] = list(value.reshape(len(value), -1))
    return pd.DataFrame(out)


def inner_effects(model: MixedModel) -> DataFrame:
    shape, beta = model.shape, model.beta
    lower, z, width = shape.lowers(model.theta)[0], shape.z, shape.width
    p = width - 1
    keys = [model.entity] + ([model.outer] if model.outer else [])
    kind = {f.name: f.dataType.simpleString() for f in model.groups.schema.fields}
    groups = model.groups
    if model.outer:
        side = model.outer_effects().select(F.col(model.outer).alias("_o"), F.col("u").alias("_v"))
        groups = groups.join(side, F.col(model.outer).eqNullSafe(F.col("_o")), "left").drop("_o")
    two = model.outer is not None

    def solve(batches):
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.reset_index(drop=True)
            cross = unpack(np.stack(batch[SUMS].to_numpy()), width)
            _, k, _ = absorb(cross, z, lower)
            sz = cross[:, z, :]
            w, h = k @ sz[:, :, :p], k @ sz[:, :, z]
            u = np.einsum("gij,gj->gi", k, sz[:, :, p]) - w @ beta
            if two:
                u = u - np.einsum("gij,gj->gi", h, np.stack(batch["_v"].to_numpy()))
            yield _effect_rows(batch, keys, cross[:, 0, 0], u, k, w, h)

    return groups.mapInPandas(solve, _effect_schema(keys, kind))


def outer_effects(model: MixedModel) -> DataFrame:
    shape, beta, outer = model.shape, model.beta, model.outer
    inner, lower = shape.lowers(model.theta)
    z, width, names = shape.z, shape.width, _sum_columns(shape.width)
    p = width - 1
    kind = {f.name: f.dataType.simpleString() for f in model.groups.schema.fields}

    def reduce_inner(batches):
        for batch in batches:
            if batch.empty:
                continue
            cross = unpack(np.stack(batch[SUMS].to_numpy()), width)
            codes, labels = pd.factorize(batch[outer], use_na_sentinel=False)
            total = np.zeros((len(labels), 1 + len(names)))
            np.add.at(total, codes, np.column_stack([cross[:, 0, 0], pack(absorb(cross, z, inner)[0])]))
            out = pd.DataFrame(total, columns=["n", *names])
            out.insert(0, outer, labels)
            yield out

    def solve(batches):
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.reset_index(drop=True)
            cross = unpack(batch[names].to_numpy(), width)
            _, k, _ = absorb(cross, z, lower)
            sz = cross[:, z, :]
            w, h = k @ sz[:, :, :p], k @ sz[:, :, z]
            u = np.einsum("gij,gj->gi", k, sz[:, :, p]) - w @ beta
            yield _effect_rows(batch, [outer], batch["n"], u, k, w, h)

    sums = ", ".join(f"{c} double" for c in names)
    parts = model.groups.select(outer, SUMS).mapInPandas(reduce_inner, f"`{outer}` {kind[outer]}, n double, {sums}")
    whole = parts.groupBy(outer).agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    return whole.mapInPandas(solve, _effect_schema([outer], kind))


def random_places(terms: Sequence[str], random: Sequence[str]) -> list[int]:
    missing = [t for t in random if t not in terms]
    if missing:
        raise ValueError(f"random slopes must be fixed terms too: {missing}")
    return [0, *[terms.index(t) + 1 for t in random]]


def identified(groups: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """Sums of products over all groups, and the columns that are no combination of earlier ones."""
    from panelyard.models.ols import sweep

    names = _sum_columns(width)
    row = groups.agg(*[F.sum(F.col(SUMS)[i]).alias(n) for i, n in enumerate(names)]).first()
    total = unpack(np.array([[row[n] or 0.0 for n in names]]), width)[0]
    return total, np.flatnonzero(sweep(total[None], width - 1)[1][0]).tolist()


def without_aliased(
    groups: DataFrame, terms: list[str], random: list[str], scales: d.Scales, kept: list[int]
) -> tuple[DataFrame, list[str], d.Scales]:
    """Group sums, terms and scales of the kept columns (0 is the intercept) and the response alone."""
    width = len(terms) + 2
    if len(kept) == width - 1 or not kept:
        return groups, terms, scales
    lost = [t for i, t in enumerate(terms, start=1) if i not in kept]
    if bad := [t for t in lost if t in random]:
        raise ValueError(f"random slopes of terms that other terms determine: {bad}")
    place = {pair: k for k, pair in enumerate(zip(*np.triu_indices(width)))}
    columns = [*kept, width - 1]
    sums = F.array(*[F.col(SUMS)[place[a, b]] for i, a in enumerate(columns) for b in columns[i:]])
    at = [k - 1 for k in kept if k]
    less = d.Scales(tuple(scales.shift[i] for i in at), tuple(scales.scale[i] for i in at), scales.y_shift, scales.y_scale)
    return groups.withColumn(SUMS, sums), [terms[i] for i in at], less


def refuse_infinite(scales: d.Scales, terms: Sequence[str], response: str) -> None:
    """An infinite value makes every sum meaningless; name the column that holds it."""
    for name, mean in zip([*terms, response], [*scales.shift, scales.y_shift], strict=True):
        if not np.isfinite(mean):
            raise ValueError(f"{name} has infinite values or NaN; leave those rows out")


def warn_unconverged(what: str, converged: bool) -> None:
    if not converged:
        warnings.warn(f"the {what} has not converged; see the model's 'converged'", RuntimeWarning, stacklevel=3)


def fit_mixed(
    df: DataFrame,
    response: str,
    terms: Sequence[str],
    entity: str,
    random: Sequence[str] = (),
    outer: str | None = None,
    max_steps: int = 25,
    crossed: bool = False,
):
    """REML fit of ``response ~ terms + (1 + random | entity)``, or with ``outer`` of
    ``(1 + random | outer) + (1 + random | outer:entity)``, an entity lying in one outer group; one that lies in
    several stops the fit. With ``crossed`` it is ``(1 + random | outer) + (1 + random | entity)`` instead: the same
    model where entities nest, and a :class:`panelyard.models.crossed.CrossedModel` where they do not.

    Eager. Rows with a missing value are left out. A term that is constant or a combination of earlier ones has no
    estimate and the others are fitted. A fit that stops before it has converged warns, and says so in ``converged``.
    """
    terms = d.order_terms(terms)
    random = list(random)
    keys = [entity] + ([outer] if outer else [])
    base = sorted({p.strip() for t in terms for p in t.split(":")} | {response})
    rows = df.select(*keys, *[F.col(f"`{c}`") for c in base if c not in keys]).na.drop("any", subset=base)
    random_places(terms, random)
    y = F.col(f"`{response}`").cast("double")
    scales = d.measure_scales(rows, terms, y)
    refuse_infinite(scales, terms, response)
    x = d.scaled_terms(terms, scales)
    y = (y - F.lit(scales.y_shift)) / F.lit(scales.y_scale)
    groups = cut_lineage(rows.groupBy(*keys).agg(d.packed_products([*x, y]).alias(SUMS)))
    total, kept = identified(groups, len(x) + 1)
    n = int(round(total[0, 0]))
    given = terms
    groups, terms, scales = without_aliased(groups, terms, random, scales, kept)
    shape = Structure(len(terms) + 2, random_places(terms, random), 2 if outer else 1)
    several = None
    if outer:
        several = groups.groupBy(entity).agg(F.count(F.lit(1)).alias("_places")).filter("_places > 1").first()
        if several is not None and not crossed:
            raise ValueError(f"{entity} {several[0]!r} lies in {several['_places']} groups of {outer}; use crossed=True")
    common = dict(given=given, aliased=[t for t in given if t not in terms])
    if several is not None:
        from panelyard.models.crossed import fit_crossed

        model = fit_crossed(groups, shape, n, terms, random, entity, outer, scales, response, max_steps, common)
        warn_unconverged("mixed model", model.converged)
        return model
    search = Search(groups, shape, Criterion(n), outer)
    theta, _, converged = minimise(search, np.concatenate([start_theta(shape.r)] * shape.levels), max_steps)
    value, beta, inverse, s2 = search.parts(theta)
    value += 2 * sum(np.log(scales.scale)) + (n - len(beta)) * 2 * np.log(scales.y_scale)
    warn_unconverged("mixed model", converged)
    return MixedModel(
        terms, random, entity, outer, scales, shape, theta, beta, inverse, float(s2), n, float(value), converged,
        search.calls, groups, response, **common,
    )
