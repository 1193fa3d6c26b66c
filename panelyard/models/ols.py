"""Linear regression: whole-frame fits with Spark ML, and one fit per entity from grouped sums."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import RFormula, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.categories import dummy_columns
from panelyard.functions.distributions import t_two_sided
from panelyard.models import design as d
from panelyard.models.design import unpack
from panelyard.operators.windows import entity_columns, holm
from panelyard.session import cut_lineage

COEFFICIENTS = "term string, estimate double, std_error double, statistic double, p_value double, lower double, upper double"


def coefficient_frame(spark, names, estimates, errors, statistics, p_values) -> DataFrame:
    """Coefficient table with bounds two standard errors away."""
    rows = [
        (n, *[None] * 6) if b is None else (n, float(b), float(s), float(t), float(p), float(b - 2 * s), float(b + 2 * s))
        for n, b, s, t, p in zip(names, estimates, errors, statistics, p_values)
    ]
    return spark.createDataFrame(rows, COEFFICIENTS)


def _feature_names(frame: DataFrame, column: str) -> list[str]:
    groups = frame.schema[column].metadata["ml_attr"]["attrs"]
    flat = [a for group in groups.values() for a in group]
    return [a["name"] for a in sorted(flat, key=lambda a: a["idx"])]


@dataclass
class LinearFit:
    coefficients: DataFrame
    formula_model: object
    model: object

    def score(self, df: DataFrame, into: str = "fitted") -> DataFrame:
        """Fitted values next to the rows they belong to."""
        rows = self.formula_model.transform(df)
        drop = [c for c in ("_features", "_kept", "_label") if c in rows.columns]
        return self.model.transform(rows).withColumnRenamed("prediction", into).drop(*drop)


def _identified(rows: DataFrame, width: int) -> list[int]:
    """Features that vary and are no combination of earlier ones, from one pass for their covariances."""
    array = vector_to_array("_features")
    x = [array[i] for i in range(width)]
    pairs = [F.covar_pop(x[i], x[j]) for i in range(width) for j in range(i, width)]
    row = rows.agg(F.array(*pairs).alias("c"), F.array(*[F.avg(c) for c in x]).alias("m")).first()
    if None in row["m"]:
        return list(range(width))
    cov = unpack(np.array([row["c"]]), width)[0]
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    varies = sd > 1e-12 * np.maximum(np.abs(row["m"]), 1.0)
    scale = np.where(varies, sd, 1.0)
    scaled = np.where(varies[:, None] & varies[None, :], cov / np.outer(scale, scale), 0.0)
    return np.flatnonzero(sweep(scaled[None], width)[1][0]).tolist()


def linear_regression(df: DataFrame, formula: str) -> LinearFit:
    """Ordinary least squares by formula; ``a:b`` interactions and text columns (dummy coded) are allowed.

    Eager: the normal equations are summed over the cluster and solved once. Rows with a missing value are
    left out. Terms that are constant or a combination of earlier ones come out NULL and the others are fitted.
    """
    prepared = RFormula(formula=formula, featuresCol="_features", labelCol="_label", handleInvalid="skip").fit(df)
    rows = prepared.transform(df)
    names = _feature_names(rows, "_features")
    kept, features = _identified(rows, len(names)), "_features"
    if not kept:
        raise ValueError("no term of the formula varies")
    if len(kept) < len(names):
        features = "_kept"
        prepared = PipelineModel([prepared, VectorSlicer(inputCol="_features", outputCol=features, indices=kept)])
        rows = prepared.transform(df)
    model = LinearRegression(
        featuresCol=features, labelCol="_label", solver="normal", regParam=0.0, standardization=True
    ).fit(rows.select(features, "_label"))

    def placed(values):
        found = dict(zip([*kept, len(names)], values))
        return [found.get(i) for i in range(len(names) + 1)]

    s = model.summary
    table = coefficient_frame(
        df.sparkSession, [*names, d.INTERCEPT], placed([*model.coefficients, model.intercept]),
        placed(s.coefficientStandardErrors), placed(s.tValues), placed(s.pValues),
    )
    return LinearFit(table, prepared, model)


def poisson_regression(df: DataFrame, formula: str) -> LinearFit:
    """Fixed-effects Poisson regression with log link, a check for the mixed version."""
    prepared = RFormula(formula=formula, featuresCol="_features", labelCol="_label", handleInvalid="skip").fit(df)
    rows = prepared.transform(df)
    model = GeneralizedLinearRegression(
        family="poisson", link="log", featuresCol="_features", labelCol="_label"
    ).fit(rows.select("_features", "_label"))
    s = model.summary
    table = coefficient_frame(
        df.sparkSession, _feature_names(rows, "_features") + [d.INTERCEPT], [*model.coefficients, model.intercept],
        s.coefficientStandardErrors, s.tValues, s.pValues,
    )
    return LinearFit(table, prepared, model)


def factor_regression(
    df: DataFrame, response: str, numeric: Sequence[str], factors: Mapping[str, Sequence[object]]
) -> DataFrame:
    """Regression with a separate level and slope per category: dummies (first level as base), and each dummy
    times each numeric column. Lazy; one row per term."""
    terms = list(numeric)
    for factor, levels in factors.items():
        df = dummy_columns(df, factor, levels)
        flags = [f"{factor}_{level}" for level in levels[1:]]
        terms += flags + [f"{x}:{flag}" for x in numeric for flag in flags]
    return grouped_regression(df, [], response, terms)


def sweep(a: np.ndarray, columns: int, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Sweep the first ``columns`` pivots of a stack of symmetric matrices, in order.

    A pivot that is (nearly) a combination of earlier ones is skipped, which is how aliased terms drop out.
    Returns the swept stack and the mask of used pivots.
    """
    a = a.copy()
    start = np.maximum(np.einsum("gii->gi", a).copy(), 1e-300)
    used = np.zeros((len(a), columns), dtype=bool)
    for k in range(columns):
        pivot = a[:, k, k]
        ok = pivot > tolerance * start[:, k]
        used[:, k] = ok
        safe = np.where(ok, pivot, 1.0)
        row = a[:, k, :] / safe[:, None]
        col = a[:, :, k].copy()
        swept = a - col[:, :, None] * row[:, None, :]
        swept[:, k, :] = row
        swept[:, :, k] = -col / safe[:, None]
        swept[:, k, k] = 1.0 / safe
        a = np.where(ok[:, None, None], swept, a)
    return a, used


def grouped_regression(df: DataFrame, entity: str | Sequence[str], response: str, terms: Sequence[str]) -> DataFrame:
    """One least-squares fit per entity, one row per entity and term.

    Lazy. Each entity is reduced to the sums of products of its columns by one aggregate with map-side combine,
    so the size of an entity does not matter; only that one small row per entity is solved in Python. Columns are
    centred and scaled by the frame's own moments first, for conditioning. Terms that an entity cannot identify
    come out NULL. ``entity=[]`` fits the whole frame.
    """
    keys = entity_columns(entity)
    terms = d.order_terms(terms)
    width = len(terms) + 2
    base = sorted({p.strip() for t in terms for p in t.split(":")} | {response})
    rows = df.select(*keys, *[F.col(f"`{c}`") for c in base if c not in keys]).na.drop("any", subset=base)
    columns = [*[d.term_column(t) for t in terms], F.col(f"`{response}`").cast("double")]
    spread = [F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0)) for c in columns]
    moments = rows.agg(
        F.struct(F.array(*[F.avg(c) for c in columns]).alias("m"), F.array(*spread).alias("s")).alias("q")
    ).scalar()
    scaled = rows.withColumn("_q", moments).select(
        *keys, *[((c - F.col("_q.m")[i]) / F.col("_q.s")[i]).alias(f"_a{i}") for i, c in enumerate(columns)]
    )
    products = d.packed_products([F.lit(1.0), *[F.col(f"_a{i}") for i in range(len(columns))]])
    sums = scaled.groupBy(*keys).agg(products.alias("_s")).withColumn("_q", moments)
    names = [d.INTERCEPT, *terms]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.reset_index(drop=True)
            cross = unpack(np.stack(batch["_s"].to_numpy()), width)
            means = np.array([np.asarray(q["m"]) for q in batch["_q"]])
            scales = np.array([np.asarray(q["s"]) for q in batch["_q"]])
            p = width - 1
            swept, used = sweep(cross, p)
            n = cross[:, 0, 0]
            free = n - used.sum(1)
            b = np.where(used, swept[:, :p, p], 0.0)
            inverse = swept[:, :p, :p] * (used[:, :, None] & used[:, None, :])
            rss = np.maximum(swept[:, p, p], 0.0)
            y_scale = scales[:, -1]
            t = np.zeros((len(batch), p, p))
            t[:, 0, 0] = y_scale
            for j in range(1, p):
                t[:, j, j] = y_scale / scales[:, j - 1]
                t[:, 0, j] = -t[:, j, j] * means[:, j - 1]
            beta = np.einsum("gij,gj->gi", t, b)
            beta[:, 0] += means[:, -1]
            s2 = np.where(free > 0, rss / np.maximum(free, 1), np.nan)
            variance = np.einsum("gij,gjk,gik->gi", t, inverse, t) * s2[:, None]
            error = np.sqrt(np.where(variance >= 0, variance, np.nan))
            with np.errstate(divide="ignore", invalid="ignore"):
                statistic = beta / error
            p_value = t_two_sided(statistic, np.broadcast_to(free[:, None], beta.shape))
            for j, name in enumerate(names):
                gone = ~used[:, j]
                out = {k: batch[k] for k in keys}
                out["term"] = name
                for column, values in (("estimate", beta), ("std_error", error), ("statistic", statistic), ("p_value", p_value)):
                    out[column] = pd.Series(np.where(gone, np.nan, values[:, j]))
                out["n"] = n.round().astype("int64")
                out["df"] = free.round().astype("int64")
                yield pd.DataFrame(out)

    schema = T.StructType(
        [df.schema[k] for k in keys]
        + T._parse_datatype_string(
            "term string, estimate double, std_error double, statistic double, p_value double, n bigint, df bigint"
        ).fields
    )
    solved = sums.mapInPandas(solve, schema)
    floats = ("estimate", "std_error", "statistic", "p_value")
    return solved.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in floats})


def grouped_term(fits: DataFrame, term: str) -> DataFrame:
    """One term of every entity's fit with Holm-adjusted p-values, largest estimate first.

    The adjustment reads the p-values several times, so the table of one row per entity is written first.
    """
    chosen = cut_lineage(fits.filter(F.col("term") == term))
    return holm(chosen, "p_value").orderBy(F.col("estimate").desc())


@dataclass
class PredictiveFit:
    """Whole-frame linear fit with its coefficient covariance, for predictive intervals."""

    terms: list[str]
    scales: d.Scales
    beta: np.ndarray
    covariance: np.ndarray
    s2: float
    n: int
    kept: list[int]

    def score(self, df: DataFrame, est: str = "est", sd: str = "sd") -> DataFrame:
        """Predictive mean and sd, sqrt(s2 * (1 + x'(X'X)^-1 x)), as plain column arithmetic."""
        every = d.scaled_terms(self.terms, self.scales)
        x = [every[i] for i in self.kept]
        mean = sum((F.lit(float(b)) * c for b, c in zip(self.beta, x)), F.lit(0.0))
        root = np.linalg.cholesky(self.covariance)
        spread = F.lit(self.s2)
        for j in range(root.shape[1]):
            part = sum((F.lit(float(root[i, j])) * x[i] for i in range(j, len(x))), F.lit(0.0))
            spread = spread + part * part
        k, m = self.scales.y_scale, self.scales.y_shift
        return df.withColumns({est: mean * F.lit(k) + F.lit(m), sd: F.sqrt(spread) * F.lit(k)})


def predictive_regression(df: DataFrame, response: str, terms: Sequence[str]) -> PredictiveFit:
    """Eager: two aggregates over the frame, a p x p solve on the driver. Terms that are constant or a combination of
    earlier ones are left out; ``kept`` numbers the others, the intercept as 0."""
    terms = d.order_terms(terms)
    base = sorted({p.strip() for t in terms for p in t.split(":")} | {response})
    rows = df.select(*[F.col(f"`{c}`") for c in base]).na.drop("any")
    y = F.col(f"`{response}`").cast("double")
    scales = d.measure_scales(rows, terms, y)
    x = d.scaled_terms(terms, scales)
    packed = rows.agg(d.packed_products([*x, (y - F.lit(scales.y_shift)) / F.lit(scales.y_scale)]).alias("s")).first()["s"]
    cross = unpack(np.array([packed]), len(x) + 1)[0]
    kept = np.flatnonzero(sweep(cross[None], len(x))[1][0])
    xx, xy, yy = cross[np.ix_(kept, kept)], cross[kept, -1], cross[-1, -1]
    inverse = np.linalg.inv(xx)
    beta = inverse @ xy
    n = int(round(cross[0, 0]))
    s2 = float((yy - beta @ xy) / (n - len(kept)))
    return PredictiveFit(terms, scales, beta, inverse * s2, s2, n, kept.tolist())
