"""Holdout split, variance explained."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.models import design as d
from panelyard.models.lmm import MixedModel
from panelyard.models.predict import predict
from panelyard.operators.windows import before_latest, latest_rows


def holdout_latest(df: DataFrame, time: str) -> tuple[DataFrame, DataFrame]:
    """(rows before the last time, rows at the last time)."""
    return before_latest(df, time), latest_rows(df, time)


def delta_variance(null: MixedModel) -> float:
    """Variance of one trial on the logit scale by the delta method, at the mean share that the null model implies: its
    intercept moved for the spread of the random effects (Nakagawa, Johnson and Schielzeth 2017)."""
    eta = null.coefficients().where(F.col("term") == d.INTERCEPT).first()["estimate"]
    spread = sum(float(np.trace(c)) for c in null.random_covariance())
    eta = eta - 0.5 * spread * math.tanh(eta * (1 + 2 * math.exp(-0.5 * spread)) / 6)
    share = 1 / (1 + math.exp(-eta))
    return 1 / (share * (1 - share))


def explained_variance(model: MixedModel, df: DataFrame, null: MixedModel | None = None) -> DataFrame:
    """Marginal and conditional R2: variance of the fixed part, of the random part averaged over the rows, and of
    the residual (pi^2/3 on the logit scale, log(1 + 1/mean) on the log scale).

    For a binomial model with its ``null`` model (intercept only, same entities) there are two rows, told apart by
    ``version``: "theoretical" with pi^2/3, and "delta" with the variance by the delta method."""
    z = [c for i, c in enumerate(d.scaled_terms(model.terms, model.scales)) if i in set(model.shape.z)]
    covariance = sum((l @ l.T for l in model.shape.lowers(model.theta)), np.zeros((len(z), len(z))))
    covariance = covariance * model.s2 * model.scales.y_scale**2
    random = sum(
        (F.lit(float(covariance[i, j])) * a * b for i, a in enumerate(z) for j, b in enumerate(z)), F.lit(0.0)
    )
    fixed = predict(model, df, "_fixed", kind="link", random=False)
    sums = fixed.agg(
        F.var_pop("_fixed").alias("var_fixed"), F.avg(random).alias("var_random"),
        F.avg(F.col(model.response).cast("double")).alias("mean"),
    )
    total = F.col("var_fixed") + F.col("var_random") + F.col("var_residual")
    shares = {"r2_marginal": F.col("var_fixed") / total, "r2_conditional": (F.col("var_fixed") + F.col("var_random")) / total}
    if null is not None:
        if model.family != "binomial":
            raise ValueError("a null model is for the binomial family")
        kinds = [("theoretical", math.pi**2 / 3), ("delta", delta_variance(null))]
        both = F.explode(F.array(*[F.struct(F.lit(n).alias("version"), F.lit(v).alias("var_residual")) for n, v in kinds]))
        named = sums.withColumn("_kind", both).select("_kind.version", "var_fixed", "var_random", "_kind.var_residual")
        return named.withColumns(shares)
    if model.family == "gaussian":
        residual = F.lit(model.residual_variance())
    elif model.family == "binomial":
        residual = F.lit(math.pi**2 / 3)
    else:
        over = F.lit(1.0 / model.extra["nb_theta"]) if model.extra.get("nb_theta") else F.lit(0.0)
        residual = F.log(1.0 + 1.0 / F.col("mean") + over)
    return sums.withColumn("var_residual", residual).withColumns(shares).drop("mean")
