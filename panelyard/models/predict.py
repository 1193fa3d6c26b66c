"""Scoring: means, predictive sds, intervals and residuals as columns next to the rows they belong to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.models import design as d
from panelyard.models.lmm import MixedModel


def _linear(weights, columns) -> Column:
    return sum((F.lit(float(w)) * c for w, c in zip(weights, columns)), F.lit(0.0))


def _with_effects(model: MixedModel, df: DataFrame, spread: bool) -> DataFrame:
    """Attach the effects of the row's entity (and outer group), with the values of an unseen one where it has
    none: zero effect, full random-effect variance."""
    p, r = model.shape.width - 1, model.shape.r
    levels = [("e", model.entity, model.effects())]
    if model.outer:
        levels.append(("o", model.outer, model.outer_effects()))
    for (tag, key, effects), lower in zip(levels, model.shape.lowers(model.theta)):
        names = ["u", "K", "W", "H"] if spread else ["u"]
        keys = model.effect_keys if tag == "e" else [key]
        side = effects.select(
            *[F.col(k).alias(f"_{tag}{i}") for i, k in enumerate(keys)], *[F.col(n).alias(f"_{tag}{n}") for n in names]
        )
        test = F.lit(True)
        for i, k in enumerate(keys):
            test = test & F.col(k).eqNullSafe(F.col(f"_{tag}{i}"))
        df = df.join(side, test, "left").drop(*[f"_{tag}{i}" for i in range(len(keys))])
        unseen = {"u": np.zeros(r), "K": (lower @ lower.T).ravel(), "W": np.zeros(r * p), "H": np.zeros(r * r)}
        df = df.withColumns(
            {f"_{tag}{n}": F.coalesce(f"_{tag}{n}", F.array(*[F.lit(float(v)) for v in unseen[n]])) for n in names}
        )
    return df


def _design(model: MixedModel, df: DataFrame) -> tuple[DataFrame, list[Column], list[Column]]:
    named = {f"_x{i}": c for i, c in enumerate(d.scaled_terms(model.terms, model.scales))}
    df = df.withColumns(named)
    x = [F.col(n) for n in named]
    return df, x, [x[j] for j in model.shape.z]


def _drop_helpers(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in keep])


def predict(
    model: MixedModel, df: DataFrame, into: str = "predicted", kind: str = "response", random: bool = True
) -> DataFrame:
    """Predictions for any rows that have the terms; entities not seen in the fit use the fixed effects only.

    ``kind="link"`` skips the inverse link. ``random=False`` leaves the random effects out.
    """
    keep = [*df.columns, into]
    df, x, z = _design(model, df)
    mean = _linear(model.beta, x)
    if random:
        df = _with_effects(model, df, spread=False)
        for tag in ("e", "o") if model.outer else ("e",):
            mean = mean + sum((F.col(f"_{tag}u")[i] * c for i, c in enumerate(z)), F.lit(0.0))
    mean = mean * F.lit(model.scales.y_scale) + F.lit(model.scales.y_shift)
    if kind == "response" and model.family != "gaussian":
        from panelyard.models.glmm import inverse_link

        mean = inverse_link(model.family, mean)
    return _drop_helpers(df.withColumn(into, mean), keep)


def predictive(model: MixedModel, df: DataFrame, est: str = "est", sd: str = "sd") -> DataFrame:
    """Closed-form predictive mean and sd of a linear mixed model on the response scale.

    The variance adds up the uncertainty of the fixed effects, of the entity's effects (for an unseen entity the
    random-effect variance), their covariance, and the residual. Variance parameters are taken as estimated; there
    is no prior.
    """
    if model.family != "gaussian":
        raise ValueError("predictive sds are defined for linear mixed models")
    if model.outer and model.effect_keys == [model.entity]:
        raise ValueError("predictive sds are not defined for crossed effects")
    keep = [*df.columns, est, sd]
    p, r = model.shape.width - 1, model.shape.r
    df, x, z = _design(model, df)
    df = _with_effects(model, df, spread=True)

    def at(name: str, i: int) -> Column:
        return F.col(name)[i]

    mean = _linear(model.beta, x) + sum((at("_eu", i) * c for i, c in enumerate(z)), F.lit(0.0))
    # x with the part that the entity's own data explains taken off
    reduced = [x[j] - sum((at("_eW", i * p + j) * z[i] for i in range(r)), F.lit(0.0)) for j in range(p)]
    quad = [sum((at("_eK", i * r + j) * z[i] * z[j] for i in range(r) for j in range(r)), F.lit(0.0))]
    if model.outer:
        mean = mean + sum((at("_ou", i) * c for i, c in enumerate(z)), F.lit(0.0))
        df = df.withColumns(
            {f"_z{j}": z[j] - sum((at("_eH", i * r + j) * z[i] for i in range(r)), F.lit(0.0)) for j in range(r)}
        )
        left = [F.col(f"_z{j}") for j in range(r)]
        reduced = [c - sum((at("_oW", i * p + j) * left[i] for i in range(r)), F.lit(0.0)) for j, c in enumerate(reduced)]
        quad.append(sum((at("_oK", i * r + j) * left[i] * left[j] for i in range(r) for j in range(r)), F.lit(0.0)))
    df = df.withColumns({f"_t{j}": c for j, c in enumerate(reduced)})
    values, vectors = np.linalg.eigh(model.inverse)
    root = vectors * np.sqrt(np.maximum(values, 0))
    fixed = F.lit(0.0)
    for j in range(p):
        part = _linear(root[:, j], [F.col(f"_t{i}") for i in range(p)])
        fixed = fixed + part * part
    total = sum(quad, fixed) + F.lit(1.0)
    k, m = model.scales.y_scale, model.scales.y_shift
    df = df.withColumns({est: mean * F.lit(k) + F.lit(m), sd: F.sqrt(total * F.lit(model.s2)) * F.lit(k)})
    return _drop_helpers(df, keep)


def with_interval(df: DataFrame, est: str = "est", sd: str = "sd", width: float = 2.0) -> DataFrame:
    """``lower`` and ``upper``: the estimate plus and minus ``width`` standard deviations."""
    return df.withColumns(
        {"upper": F.col(est) + F.lit(width) * F.col(sd), "lower": F.col(est) - F.lit(width) * F.col(sd)}
    )


def back_transformed(df: DataFrame, columns=("est", "lower", "upper"), rounded: bool = False) -> DataFrame:
    return df.withColumns({f"{c}_level": F.bround(F.exp(c)) if rounded else F.exp(c) for c in columns})


def residuals(model: MixedModel, df: DataFrame, fitted: str = "fitted", residual: str = "residual") -> DataFrame:
    """Fitted values with response residuals, or deviance residuals for the binomial and Poisson families."""
    out = predict(model, df, fitted)
    y, mu = F.col(model.response).cast("double"), F.col(fitted)
    if model.family == "gaussian":
        return out.withColumn(residual, y - mu)

    def term(a: Column, b: Column) -> Column:
        return F.when(a == 0, F.lit(0.0)).otherwise(a * F.log(a / b))

    if model.family == "binomial":
        trials = model.extra["trials"]
        size = F.col(trials).cast("double") if isinstance(trials, str) else F.lit(float(trials))
        part = term(y, size * mu) + term(size - y, size * (1 - mu))
        expected = size * mu
    elif model.extra.get("nb_theta"):
        t = F.lit(model.extra["nb_theta"])
        part, expected = term(y, mu) - (y + t) * F.log((y + t) / (mu + t)), mu
    else:
        part, expected = term(y, mu) - (y - mu), mu
    return out.withColumn(residual, F.signum(y - expected) * F.sqrt(F.greatest(F.lit(0.0), 2 * part)))
