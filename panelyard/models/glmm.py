"""Generalised linear mixed models: penalised quasi-likelihood with one or two nested levels, and the Laplace likelihood.

**Rows.** They are written once, bucketed by entity and chunk. A step joins the current effects of the entities to
them and sums per entity; the rows are read where they lie, and only effects and sums are shuffled. An entity with many
rows is cut into chunks by a number each row gets when it is written, and its effects are repeated once per chunk.

**Quasi-likelihood.** Each step linearises the response around the current fit, sums weighted products per entity, and
solves the resulting linear mixed model on the group table, the inner level eliminated into the outer one. Variances
come out too small where counts per entity are small.

**Laplace.** Starts from the quasi-likelihood fit. For given coefficients and covariance factor every entity's effects
are moved to the mode of its posterior by Newton steps on its own sums, and the integral over the effects is replaced by
the curvature there. One pass over the rows gives each entity's log-likelihood, its first two derivatives and the third
ones that the curvature changes by; the value and its gradient for all coefficients follow from that small table. The
effects of the next pass are predicted to second order, so a quasi-Newton step costs one pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.models import design as d
from panelyard.models.lmm import (
    SUMS,
    Criterion,
    MixedModel,
    Search,
    Structure,
    absorb,
    derivatives,
    factor,
    identified,
    minimise,
    random_places,
    refuse_infinite,
    start_theta,
    stencil,
    warn_unconverged,
    without_aliased,
)
from panelyard.operators.windows import entity_columns, mark_hot
from panelyard.session import cut_lineage, shared_path

CHUNK = "_chunk"
#: Linear predictors are kept within these bounds, in fits and in predictions.
EXTREME = 30.0


def bounded(eta: Column) -> Column:
    return F.greatest(F.lit(-EXTREME), F.least(F.lit(EXTREME), eta))


def inverse_link(family: str, eta: Column) -> Column:
    eta = bounded(eta)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)) if family == "binomial" else F.exp(eta)


def variance(family: str, mu: Column, theta: float | None) -> Column:
    if family == "binomial":
        return mu * (F.lit(1.0) - mu)
    if family == "poisson" or not theta:
        return mu
    return mu + mu * mu / F.lit(theta)


def spread_hot(df: DataFrame, entity: str | Sequence[str], rows_per_chunk: int) -> DataFrame:
    """Add a chunk number: 0 for ordinary entities; for large ones rows are dealt by their own numbers, equal rows too.
    The numbers hold for what is written from this frame."""
    parts = F.ceil(F.col("_n") / F.lit(rows_per_chunk))
    spread = F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_row"), parts))
    marked = mark_hot(df, entity_columns(entity), rows_per_chunk).withColumn("_row", F.monotonically_increasing_id())
    return marked.withColumn(CHUNK, spread.cast("int")).drop("_n", "_row")


@dataclass
class Bucketed:
    """Rows written once, found again without a shuffle by any join or sum over ``keys`` and chunk."""

    rows: DataFrame
    name: str
    keys: list[str]

    @classmethod
    def write(cls, df: DataFrame, keys: list[str]) -> Bucketed:
        spark = df.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"panelyard_{uuid.uuid4().hex}"
        # Dealt by the same hash as the buckets, so a task writes one file.
        dealt = df.repartition(buckets, *keys, CHUNK)
        dealt.write.bucketBy(buckets, *keys, CHUNK).option("path", shared_path(spark, "glmm-rows")).saveAsTable(name)
        return cls(spark.table(name), name, keys)

    def forget(self) -> None:
        """Take the name out of the session's catalog; the files stay in the shared folder."""
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def with_effects(self, effects: DataFrame) -> DataFrame:
        """Rows with the effects (keys, _u, _b, _chunks) of their entity."""
        each = effects.select(
            *[F.col(k).alias(f"_e{i}") for i, k in enumerate(self.keys)], "_u", "_b",
            F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_c"),
        )
        match = F.col(CHUNK) == F.col("_c")
        for i, k in enumerate(self.keys):
            match = match & (F.col(k) == F.col(f"_e{i}"))
        # A hash table of the effects in every bucket: the rows are neither moved nor sorted.
        return self.rows.join(each.hint("shuffle_hash"), match)


@dataclass
class Family:
    """What a step needs of a response: ``name``, the dispersion of the negative binomial, and the design's columns."""

    name: str
    cols: list[Column]
    z: list[int]
    nb_theta: float | None = None

    def start(self) -> tuple[Column, Column]:
        """Mean and linear predictor from the response alone, pulled off the edges of its range."""
        y, size = F.col("_y"), F.col("_size")
        if self.name == "binomial":
            mu = (y * size + 0.5) / (size + 1.0)
            return mu, F.log(mu / (1.0 - mu))
        return y + 0.1, F.log(y + 0.1)

    def predictor(self, beta: np.ndarray) -> tuple[Column, Column]:
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, self.cols)), F.lit(0.0))
        eta = bounded(eta + sum((F.col("_b")[i] * self.cols[j] for i, j in enumerate(self.z)), F.lit(0.0)))
        return inverse_link(self.name, eta), eta

    def log_likelihood(self, eta: Column) -> Column:
        """Without the terms that no coefficient enters."""
        y, size = F.col("_y"), F.col("_size")
        if self.name == "binomial":
            return size * (y * eta - F.log1p(F.exp(eta)))
        return y * eta - F.exp(eta)


def step_sums(rows: DataFrame, keys: list[str], family: Family, mu: Column, eta: Column, third: bool, moved: bool) -> DataFrame:
    """Per entity at the current fit: weighted products of the design and the working response, rows, chunks, moments of
    the dispersion; with ``third`` the log-likelihood and the sums by which the weights change; with ``moved`` the
    effects that the rows came with. Summed per chunk first, which needs no shuffle."""
    y, size = F.col("_y"), F.col("_size")
    slope = mu * (1.0 - mu) if family.name == "binomial" else mu
    weight = size * slope * slope / variance(family.name, mu, family.nb_theta)
    made = rows.select(
        *keys, CHUNK, "_y", weight.alias("_w"), (eta + (y - mu) / slope).alias("_zeta"), mu.alias("_mu"),
        *[c.alias(f"_x{i}") for i, c in enumerate(family.cols)],
        *([family.log_likelihood(eta).alias("_like"), (size * slope * (1.0 - 2.0 * mu) if family.name == "binomial" else mu).alias("_dw")] if third else []),
        *(["_u", "_b"] if moved else []),
    )
    x = [F.col(f"_x{i}") for i in range(len(family.cols))]
    y, mu = F.col("_y"), F.col("_mu")
    sums = {
        SUMS: d.packed_products([*x, F.col("_zeta")], F.col("_w")),
        "_extra": F.array(F.sum((y - mu) ** 2 - mu), F.sum(mu**2)),
        "_rows": F.count(F.lit(1)),
        "_chunks": F.max(CHUNK) + 1,
    }
    if third:
        z = [x[j] for j in family.z]
        pairs = [(a, b) for i, a in enumerate(z) for b in z[i:]]
        sums["_like"] = F.sum("_like")
        sums["_third"] = F.array(*[F.sum(F.col("_dw") * a * b * c) for a, b in pairs for c in x])
    if moved:
        sums |= {"_u": F.first("_u"), "_b": F.first("_b")}
    return made.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])


def _effects(model: MixedModel, keys: list[str]) -> DataFrame:
    """Current effects of every entity on the linear predictor, those of its outer group included."""
    shape, beta = model.shape, model.beta
    p, z, lower = shape.width - 1, shape.z, shape.lowers(model.theta)[0]
    groups, two = model.groups, model.outer is not None
    if two:
        side = model.outer_effects().select(F.col(model.outer).alias("_o"), F.col("u").alias("_v"))
        groups = groups.join(side, F.col(model.outer) == F.col("_o"))
    kind = {f.name: f.dataType.simpleString() for f in model.groups.schema.fields}

    def solve(batches):
        for batch in batches:
            if batch.empty:
                continue
            cross = d.unpack(np.stack(batch[SUMS].to_numpy()), shape.width)
            _, k, _ = absorb(cross, z, lower)
            rest = cross[:, z, p] - cross[:, z, :p] @ beta
            if two:
                outer = np.stack(batch["_v"].to_numpy())
                rest = rest - np.einsum("gij,gj->gi", cross[:, z][:, :, z], outer)
            b = np.einsum("gij,gj->gi", k, rest)
            if two:
                b = b + outer
            yield pd.DataFrame({**{key: batch[key] for key in keys}, "_u": list(b), "_b": list(b), "_chunks": batch["_chunks"]})

    names = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    return groups.mapInPandas(solve, f"{names}, _u array<double>, _b array<double>, _chunks int")


class Laplace:
    """Value and gradient of -log L per entity, from its sums at effects near their mode."""

    def __init__(self, shape: Structure, theta: np.ndarray, beta: np.ndarray):
        self.shape, self.beta, self.theta = shape, beta, theta
        self.lower = factor(theta, shape.r)
        cols, rows = np.triu_indices(shape.r)
        self.entries = list(zip(rows.tolist(), cols.tolist(), strict=True))

    def parts(self, batch: pd.DataFrame):
        """(values, gradients, modes, changes of the modes with the parameters, information, distance to the mode)."""
        z, r, p, lower = self.shape.z, self.shape.r, self.shape.width - 1, self.lower
        cross = d.unpack(np.stack(batch[SUMS].to_numpy()), self.shape.width)
        g, many = cross[:, :p, :p], len(batch)
        u, b = np.stack(batch["_u"].to_numpy()), np.stack(batch["_b"].to_numpy())
        score = cross[:, :p, p] - g @ self.beta - np.einsum("gij,gj->gi", g[:, :, z], b)
        third = np.zeros((many, r, r, p))
        packed = np.stack(batch["_third"].to_numpy()).reshape(many, -1, p)
        for k, (i, j) in enumerate(zip(*np.triu_indices(r), strict=True)):
            third[:, i, j] = third[:, j, i] = packed[:, k]
        gzz = g[:, z][:, :, z]
        a = lower.T @ gzz @ lower + np.eye(r)
        inverse = np.linalg.inv(a)
        slope = u - score[:, z] @ lower
        move = -np.einsum("gij,gj->gi", inverse, slope)
        mode = u + move
        # Change of log|a| / 2 with the linear predictor's slopes along each design column.
        bent = 0.5 * np.einsum("gij,gjic->gc", inverse, np.einsum("ai,gabc,bj->gijc", lower, third, lower))
        along = bent[:, z] @ lower
        value = (
            -batch["_like"].to_numpy() + 0.5 * (u * u).sum(1) + 0.5 * (slope * move).sum(1)
            + 0.5 * np.linalg.slogdet(a)[1] + (along * move).sum(1)
        )
        score = score - np.einsum("gij,gj->gi", g[:, :, z], move @ lower.T)
        by_beta = -np.einsum("gij,jk,gkc->gic", inverse, lower.T, g[:, z])
        grad_beta = -score + bent + np.einsum("gi,gic->gc", along, by_beta)
        grad_theta, by_theta = np.zeros((many, len(self.entries))), np.zeros((many, r, len(self.entries)))
        inner = lower.T @ gzz
        for m, (row, col) in enumerate(self.entries):
            bend = np.zeros((many, r, r))
            bend[:, :, col] += inner[:, :, row]
            bend[:, col, :] += inner[:, :, row]
            trace = 0.5 * np.einsum("gij,gji->g", inverse, bend) + bent[:, z[row]] * mode[:, col]
            push = inner[:, :, row] * mode[:, [col]]
            push[:, col] -= score[:, z[row]]
            by_theta[:, :, m] = -np.einsum("gij,gj->gi", inverse, push)
            grad_theta[:, m] = -score[:, z[row]] * mode[:, col] + trace + np.einsum("gi,gi->g", along, by_theta[:, :, m])
        half = np.einsum("ij,gjc->gic", lower.T, g[:, z])
        information = g - np.einsum("gia,gij,gjb->gab", half, inverse, half)
        gradient = np.concatenate([grad_theta, grad_beta], axis=1)
        return value, gradient, mode, np.concatenate([by_theta, by_beta], axis=2), information, np.abs(move).max(1)

    def totals(self, groups: DataFrame) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Value, gradient, information of the coefficients, and the largest distance to a mode: one job."""
        p, m = self.shape.width - 1, len(self.entries)

        def run(batches):
            for batch in batches:
                if len(batch):
                    value, gradient, _, _, information, move = self.parts(batch)
                    sums = [value.sum(), *gradient.sum(0), *d.pack(information.sum(0))]
                    yield pd.DataFrame([[move.max(), *sums]], columns=["far", *names])

        names = [f"s{i}" for i in range(1 + m + p + p * (p + 1) // 2)]
        kind = ", ".join(f"{n} double" for n in ["far", *names])
        rows = groups.select("_like", "_third", "_u", "_b", SUMS).mapInPandas(run, kind)
        out = rows.agg(F.max("far").alias("far"), *[F.sum(n).alias(n) for n in names]).first()
        sums = np.array([out[n] or 0.0 for n in names])
        return sums[0], sums[1 : 1 + m + p], d.unpack(sums[None, 1 + m + p :], p)[0], float(out["far"] or 0.0)

    def effects_after(self, groups: DataFrame, keys: list[str], step: np.ndarray) -> DataFrame:
        """Effects predicted for the parameters after ``step``."""
        kind = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
        new = factor(self.theta + step[: len(self.entries)], self.shape.r)

        def run(batches):
            for batch in batches:
                if batch.empty:
                    continue
                _, _, mode, change, _, _ = self.parts(batch)
                u = mode + change @ step
                yield pd.DataFrame({**{k: batch[k] for k in keys}, "_u": list(u), "_b": list(u @ new.T), "_chunks": batch["_chunks"]})

        names = ", ".join(f"`{k}` {kind[k]}" for k in keys)
        columns = groups.select(*keys, "_like", "_third", "_u", "_b", SUMS, "_chunks")
        return columns.mapInPandas(run, f"{names}, _u array<double>, _b array<double>, _chunks int")


def _to_spherical(effects: DataFrame, lower: np.ndarray) -> DataFrame:
    """Effects in units of the covariance factor, which the Laplace steps work with."""
    back = np.linalg.pinv(lower)
    u = F.array(*[sum((F.lit(float(v)) * F.col("_b")[j] for j, v in enumerate(line)), F.lit(0.0)) for line in back])
    names = [c for c in effects.columns if c not in ("_u", "_b")]
    b = F.array(*[sum((F.lit(float(v)) * F.col("_s")[j] for j, v in enumerate(line)), F.lit(0.0)) for line in lower])
    return effects.select(*names, u.alias("_s")).select(*names, F.col("_s").alias("_u"), b.alias("_b"))


def refine(rows: Bucketed, family: Family, model: MixedModel, max_passes: int, tolerance: float) -> MixedModel:
    """The Laplace fit, from the quasi-likelihood fit ``model``, by quasi-Newton steps of one pass each."""
    keys, shape = rows.keys, model.shape
    m = shape.per_level
    phi = np.concatenate([model.theta, model.beta])
    search = Search(model.groups, shape, Criterion(model.n, unit_scale=True))
    points, h = stencil(model.theta)
    curve = np.zeros((len(phi), len(phi)))
    # Both blocks of the curvature, halved as the search works on -2 log L.
    curve[:m, :m] = derivatives(search(points), h, m)[1] / 2
    curve[m:, m:] = np.linalg.inv(model.inverse)
    w, v = np.linalg.eigh(curve)
    curve = (v * np.maximum(np.abs(w), 1e-6 * np.max(np.abs(w)))) @ v.T
    effects = _to_spherical(_effects(model, keys), factor(model.theta, shape.r))
    value, gradient, step, groups, converged, passes, information = np.inf, None, np.zeros(len(phi)), None, False, 0, None
    while passes < max_passes:
        passes += 1
        new = phi + step
        at = Laplace(shape, new[:m], new[m:])
        mu, eta = family.predictor(new[m:])
        found = cut_lineage(step_sums(rows.with_effects(effects), keys, family, mu, eta, third=True, moved=True))
        new_value, slope, new_information, far = at.totals(found)
        if gradient is not None and new_value > value + 1e-12 * max(1.0, abs(value)):
            step = step / 4  # too far: back to the last fit, and a shorter step from there
            if np.max(np.abs(step)) < 1e-9:
                break
            effects = last.effects_after(groups, keys, step)
            continue
        if gradient is not None:
            change = slope - gradient
            if step @ change > 1e-12:
                bs = curve @ step
                curve = curve + np.outer(change, change) / (step @ change) - np.outer(bs, bs) / (step @ bs)
        phi, value, gradient, groups, last, information = new, new_value, slope, found, at, new_information
        step = -np.linalg.solve(curve, gradient)
        if -gradient @ step / 2 < tolerance + 1e-14 * abs(value) and far < 1e-3:
            converged = True
            break
        effects = last.effects_after(groups, keys, step)
    return MixedModel(
        model.terms, model.random, model.entity, None, model.scales, shape, phi[:m], phi[m:], np.linalg.inv(information), 1.0,
        model.n, 2 * float(value), converged, model.calls + passes, groups, model.response, model.family,
        {**model.extra, "method": "laplace", "passes": passes}, model.given, model.aliased,
    )


def fit_glmm(
    df: DataFrame,
    response: str,
    terms: Sequence[str],
    entity: str,
    random: Sequence[str] = (),
    family: str = "binomial",
    trials: str | float = 1.0,
    max_steps: int = 30,
    tolerance: float = 1e-5,
    rows_per_chunk: int = 2_000_000,
    outer: str | None = None,
    method: str = "quasi",
) -> MixedModel:
    """``response ~ terms + (1 + random | entity)`` with a logit (binomial) or log (poisson, negbinomial) link, or with
    ``outer`` of ``(1 + random | outer) + (1 + random | outer:entity)``.

    For the binomial family ``response`` is the number of successes out of ``trials`` (a column or a constant).
    ``method`` is ``"quasi"`` for penalised quasi-likelihood or ``"laplace"`` for the Laplace likelihood (binomial and
    Poisson, one level). The dispersion of the negative binomial is re-estimated by moments at every step. Eager. Rows
    with a missing value, the entity's included, are left out; a term that is constant or a combination of earlier ones
    has no estimate. A fit that stops before it has converged warns, and says so in ``converged``.
    """
    if family not in ("binomial", "poisson", "negbinomial"):
        raise ValueError("family is 'binomial', 'poisson' or 'negbinomial'")
    if method not in ("quasi", "laplace") or (method == "laplace" and (outer or family == "negbinomial")):
        raise ValueError("method is 'quasi', or 'laplace' for the binomial and Poisson families with one level")
    given, random = d.order_terms(terms), list(random)
    terms = given
    random_places(terms, random)
    keys = [entity] + ([outer] if outer else [])
    base = sorted({p.strip() for t in terms for p in t.split(":")} | {response} | ({trials} if isinstance(trials, str) else set()))
    rows = df.select(*keys, *[F.col(f"`{c}`") for c in base if c not in keys]).na.drop("any", subset=[*base, *keys])
    scales = d.measure_scales(rows, terms)
    refuse_infinite(scales, terms, response)
    size = F.col(f"`{trials}`").cast("double") if isinstance(trials, str) else F.lit(float(trials))
    size = size if family == "binomial" else F.lit(1.0)
    x = d.scaled_terms(terms, scales)
    slim = spread_hot(rows, keys, rows_per_chunk).select(
        *keys,
        CHUNK,
        (F.col(f"`{response}`").cast("double") / size).alias("_y"),
        size.alias("_size"),
        *[c.alias(f"_t{i}") for i, c in enumerate(x[1:], start=1)],
    )
    table = Bucketed.write(slim, keys)
    try:
        fitted = _quasi(table, family, given, random, keys, scales, response, trials, max_steps, tolerance)
        model, kind = fitted
        if method == "laplace":
            model = refine(table, kind, model, 2 * max_steps, 1e-8)
    finally:
        table.forget()
    warn_unconverged(f"{family} model", model.converged)
    return model


def _quasi(
    table: Bucketed, family: str, given: list[str], random: list[str], keys: list[str], scales: d.Scales, response: str,
    trials: str | float, max_steps: int, tolerance: float,
) -> tuple[MixedModel, Family]:
    outer = keys[1] if len(keys) > 1 else None
    terms, place = given, list(range(len(given) + 1))
    kind = Family(family, [F.lit(1.0), *[F.col(f"_t{i}") for i in place[1:]]], random_places(terms, random))
    mu, eta = kind.start()
    work, theta, beta, model, converged, calls = table.rows, None, np.zeros(len(given) + 1), None, False, 0
    for step in range(max_steps):
        groups = cut_lineage(step_sums(work, keys, kind, mu, eta, third=False, moved=False))
        if step == 0:
            count = groups.agg(F.sum("_rows").alias("n"), F.count_distinct(keys[0]).alias("e"), F.count(F.lit(1)).alias("g")).first()
            if outer and count["e"] < count["g"]:
                raise ValueError(f"an entity of {keys[0]} lies in several groups of {outer}")
            n = int(count["n"] or 0)
            _, kept = identified(groups, len(given) + 2)
            groups, terms, scales = without_aliased(groups, given, random, scales, kept)
            if len(terms) < len(given):
                kind.cols = [kind.cols[i] for i in kept]
                kind.z, beta = random_places(terms, random), np.zeros(len(kept))
            shape = Structure(len(terms) + 2, kind.z, 2 if outer else 1)
            theta = np.concatenate([start_theta(shape.r)] * shape.levels)
            rule = Criterion(n, unit_scale=True)
        if family == "negbinomial":
            over = groups.agg(F.sum(F.col("_extra")[0]).alias("a"), F.sum(F.col("_extra")[1]).alias("b")).first()
            kind.nb_theta = float(over["b"] / over["a"]) if over["a"] and over["a"] > 0 else None
        old = np.concatenate([theta, beta])
        search = Search(groups, shape, rule, outer)
        theta, value, _ = minimise(search, theta, max_steps=5, scan=step == 0)
        _, beta, inverse, _ = search.parts(theta)
        calls += search.calls
        model = MixedModel(
            terms, random, keys[0], outer, scales, shape, theta, beta, inverse, 1.0, n, float(value), False, calls,
            groups, response, family, {"trials": trials, "nb_theta": kind.nb_theta, "steps": step + 1, "method": "quasi"},
            given, [t for t in given if t not in terms],
        )
        if np.max(np.abs(np.concatenate([theta, beta]) - old)) < tolerance * max(1.0, np.max(np.abs(beta))):
            converged = True
            break
        work = table.with_effects(_effects(model, keys))
        mu, eta = kind.predictor(beta)
    model.converged = converged
    return model, kind
