"""Models against dense textbook formulas on small fixtures, and recovery of simulated parameters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.models import evaluate, ols, predict
from panelyard.models.glmm import fit_glmm, spread_hot
from panelyard.models.lmm import factor, fit_mixed
from panelyard.models.store import load_model, save_model
from panelyard.session import shared_path


def mixed_data(nested=False):
    rng = np.random.default_rng(4)
    regions, per, n = (6, 5, 9) if nested else (1, 18, 11)
    rows = []
    for r in range(regions):
        v = rng.normal(size=2) * [1.2, 0.15] if nested else np.zeros(2)
        for e in range(per):
            u = rng.normal(size=2) * [0.9, 0.1]
            for t in range(n - (e % 3)):
                c = rng.normal()
                y = 40 + 0.3 * t + 0.5 * c + (u + v) @ [1, t] + rng.normal() * 0.6
                rows.append((f"r{r}", f"g{r}_{e}", float(t + 100), c, y))
    return pd.DataFrame(rows, columns=["r", "g", "t", "c", "y"])


def dense_parts(pdf, model):
    """Marginal covariance (in units of the residual variance) on the model's own scaled columns."""
    s = model.scales
    x = np.column_stack([np.ones(len(pdf)), *[(pdf[t] - m) / k for t, m, k in zip(model.terms, s.shift, s.scale)]])
    z = x[:, model.shape.z]
    v = np.eye(len(pdf))
    for key, lower in zip([model.entity, model.outer], model.shape.lowers(model.theta)):
        same = pdf[key].to_numpy()[:, None] == pdf[key].to_numpy()[None, :]
        v += (z @ lower @ lower.T @ z.T) * same
    return x, z, v, ((pdf[model.response] - s.y_shift) / s.y_scale).to_numpy()


def dense_criterion(pdf, model, theta):
    import copy

    m = copy.copy(model)
    m.theta = theta
    x, _, v, y = dense_parts(pdf, m)
    w = np.linalg.inv(v)
    a = x.T @ w @ x
    beta = np.linalg.solve(a, x.T @ w @ y)
    rss = (y - x @ beta) @ w @ (y - x @ beta)
    free = len(y) - len(beta)
    value = np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + free * (1 + np.log(2 * np.pi * rss / free))
    return value, beta, rss / free, np.linalg.inv(a)


@pytest.mark.parametrize("nested", [False, True])
def test_mixed_model_equals_dense_reml(spark, nested):
    pdf = mixed_data(nested)
    df = spark.createDataFrame(pdf).repartition(3)
    model = fit_mixed(df, "y", ["t", "c"], "g", ["t"], outer="r" if nested else None)
    assert model.converged
    value, beta, s2, inverse = dense_criterion(pdf, model, model.theta)
    raw = value + 2 * np.log(model.scales.scale).sum() + (len(pdf) - 3) * 2 * np.log(model.scales.y_scale)
    assert model.criterion == pytest.approx(raw, rel=1e-9)
    np.testing.assert_allclose(model.beta, beta, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(model.inverse, inverse, rtol=1e-6, atol=1e-12)
    assert model.s2 == pytest.approx(s2, rel=1e-8)
    # The optimum: every small move makes the criterion larger.
    for i in range(len(model.theta)):
        for h in (-0.01, 0.01):
            moved = model.theta.copy()
            moved[i] += h
            assert dense_criterion(pdf, model, moved)[0] > value - 1e-7


@pytest.mark.parametrize("nested", [False, True])
def test_predictive_equals_dense_conditional(spark, nested):
    pdf = mixed_data(nested)
    model = fit_mixed(spark.createDataFrame(pdf), "y", ["t", "c"], "g", ["t"], outer="r" if nested else None)
    new = pd.DataFrame(
        [("r0", "g0_1", 115.0, 0.3), ("r0", "g0_2", 101.0, -1.0), ("r0", "unseen", 108.0, 0.0), ("other", "unseen", 108.0, 1.0)],
        columns=["r", "g", "t", "c"],
    )
    got = predict.predictive(model, spark.createDataFrame(new)).toPandas()
    both = pd.concat([pdf, new.assign(y=0.0)], ignore_index=True)
    x, _, v, y = dense_parts(both, model)
    n = len(pdf)
    w = np.linalg.inv(v[:n, :n])
    inverse = np.linalg.inv(x[:n].T @ w @ x[:n])
    beta = inverse @ x[:n].T @ w @ y[:n]
    for i in range(len(new)):
        k = v[n + i, :n]
        est = x[n + i] @ beta + k @ w @ (y[:n] - x[:n] @ beta)
        d = x[n + i] - k @ w @ x[:n]
        var = model.s2 * (v[n + i, n + i] - k @ w @ k + d @ inverse @ d)
        row = got[(got.g == new.g[i]) & (got.t == new.t[i]) & (got.r == new.r[i])].iloc[0]
        assert row["est"] == pytest.approx(est * model.scales.y_scale + model.scales.y_shift, rel=1e-8)
        assert row["sd"] == pytest.approx(np.sqrt(var) * model.scales.y_scale, rel=1e-7)


def test_saved_model_predicts_the_same(spark):
    pdf = mixed_data()
    df = spark.createDataFrame(pdf)
    model = fit_mixed(df, "y", ["t", "c"], "g", ["t"])
    again = load_model(spark, save_model(model, shared_path(spark, "test-model")))
    a = predict.predict(model, df).agg(F.sum("predicted")).first()[0]
    assert predict.predict(again, df).agg(F.sum("predicted")).first()[0] == pytest.approx(a, rel=1e-12)
    effects = model.group_effects().toPandas()
    assert len(effects) == 18 and abs(effects["t"].mean()) < 0.1
    r2 = evaluate.explained_variance(model, df).first()
    assert 0 < r2["r2_marginal"] < r2["r2_conditional"] < 1


def test_factor_layout():
    np.testing.assert_array_equal(factor(np.array([1.0, 2.0, 3.0]), 2), [[1, 0], [2, 3]])


def test_zero_variance_is_found(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.repeat([f"g{i}" for i in range(20)], 10), "y": rng.normal(size=200)})
    means = pdf.groupby("g")["y"].transform("mean")
    pdf["y"] = pdf["y"] - means  # no variation between groups at all
    model = fit_mixed(spark.createDataFrame(pdf), "y", [], "g")
    assert model.random_covariance()[0][0, 0] < 1e-6


def test_grouped_regression_with_aliased_and_short_groups(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        for t in range(12):
            flag = float(t > 5) if g else 0.0  # group 0 never switches
            rows.append((f"g{g}", t + 50.0, flag, 3 + 0.5 * t - flag + rng.normal() * 0.2))
    rows += [("short", 1.0, 0.0, 2.0), ("short", 2.0, 0.0, 4.0), ("gone", None, 0.0, 1.0)]
    pdf = pd.DataFrame(rows, columns=["g", "t", "f", "y"])
    df = spark.createDataFrame(rows, "g string, t double, f double, y double")
    out = ols.grouped_regression(df, "g", "y", ["f:t", "t", "f"]).toPandas().set_index(["g", "term"])
    for g, part in pdf.dropna().groupby("g"):
        columns = {"(Intercept)": np.ones(len(part)), "t": part.t, "f": part.f, "f:t": part.f * part.t}
        used = [c for c in columns if out.loc[(g, c), "estimate"] == out.loc[(g, c), "estimate"] and out.loc[(g, c), "estimate"] is not None]
        assert used == (["(Intercept)", "t"] if g in ("g0", "short") else list(columns))
        x = np.column_stack([columns[c] for c in used])
        beta, *_ = np.linalg.lstsq(x, part.y, rcond=None)
        np.testing.assert_allclose([out.loc[(g, c), "estimate"] for c in used], beta, rtol=1e-5, atol=1e-6)
        free = len(part) - len(used)
        assert out.loc[(g, "t"), "df"] == free
        if free:
            rss = ((part.y - x @ beta) ** 2).sum()
            error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / free)
            np.testing.assert_allclose([out.loc[(g, c), "std_error"] for c in used], error, rtol=1e-4)
    tidy = ols.grouped_term(ols.grouped_regression(df, "g", "y", ["t"]), "t").toPandas()
    assert list(tidy.estimate) == sorted(tidy.estimate, reverse=True)


def test_linear_regression_scores_rows(spark):
    df = spark.createDataFrame([(float(i), i % 2, 2.0 * i + (i % 2)) for i in range(20)], "x double, f int, y double")
    fit = ols.linear_regression(df.withColumn("y", F.col("y") + F.rand(1) * 1e-3), "y ~ x + f")
    got = {r["term"]: r["estimate"] for r in fit.coefficients.collect()}
    assert got["x"] == pytest.approx(2, abs=1e-3) and got["f"] == pytest.approx(1, abs=1e-2)
    assert fit.score(df).columns == ["x", "f", "y", "fitted"]


def count_data():
    rng = np.random.default_rng(8)
    g = np.repeat(np.arange(60), 25)
    t = np.tile(np.arange(25), 60) * 1.0
    u = rng.normal(size=60)[g] * 0.5
    eta = -0.5 + 0.06 * (t - 12) + u
    share = 1 / (1 + np.exp(-eta))
    rate = np.exp(1.5 + 0.04 * (t - 12) + u)
    return pd.DataFrame({
        "g": [f"g{i}" for i in g], "t": t, "k": rng.binomial(100, share), "c": rng.poisson(rate),
        "nb": rng.poisson(rate * rng.gamma(4, 1 / 4, size=len(g))),
    })


@pytest.mark.parametrize(
    ("response", "family", "slope"), [("k", "binomial", 0.06), ("c", "poisson", 0.04), ("nb", "negbinomial", 0.04)]
)
def test_glmm_recovers_parameters(spark, response, family, slope):
    df = spark.createDataFrame(count_data()).repartition(3)
    model = fit_glmm(df, response, ["t"], "g", family=family, trials=100.0, rows_per_chunk=10)
    assert model.converged
    got = {r["term"]: r for r in model.coefficients().collect()}
    assert abs(got["t"]["estimate"] - slope) < 4 * got["t"]["std_error"]
    assert np.sqrt(model.random_covariance()[0][0, 0]) == pytest.approx(0.5, abs=0.13)
    if family == "negbinomial":
        assert model.extra["nb_theta"] == pytest.approx(4, rel=0.35)
    scored = predict.predict(model, spark.createDataFrame([("g1", 30.0), ("new", 30.0)], "g string, t double")).toPandas()
    new = got["(Intercept)"]["estimate"] + 30 * got["t"]["estimate"]
    expected = 1 / (1 + np.exp(-new)) if family == "binomial" else np.exp(new)
    assert scored[scored.g == "new"].predicted.iloc[0] == pytest.approx(expected, rel=1e-9)
    residual = predict.residuals(model, df).agg(F.avg("residual").alias("m"), F.count("residual").alias("n")).first()
    assert residual["n"] == 1500 and abs(residual["m"]) < 0.2


def test_chunks_do_not_change_the_fit(spark):
    df = spark.createDataFrame(count_data())
    one = fit_glmm(df, "c", ["t"], "g", family="poisson", rows_per_chunk=1_000_000)
    many = fit_glmm(df, "c", ["t"], "g", family="poisson", rows_per_chunk=7)
    np.testing.assert_allclose(one.beta, many.beta, rtol=1e-6)
    cut = spread_hot(df, "g", 7)
    assert cut.count() == 1500 and cut.agg(F.max("_chunk")).first()[0] == 3


def test_predictive_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40) + 1000
    y = 3 * x + rng.normal(size=40)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    fit = ols.predictive_regression(df, "y", ["x"])
    out = predict.with_interval(fit.score(spark.createDataFrame([(1004.0,)], "x double"))).first()
    design = np.column_stack([np.ones(40), x - x.mean()])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    s2 = ((y - design @ beta) ** 2).sum() / 38
    at = np.array([1, 1004 - x.mean()])
    sd = np.sqrt(s2 * (1 + at @ np.linalg.inv(design.T @ design) @ at))
    assert out["est"] == pytest.approx(at @ beta, rel=1e-9) and out["sd"] == pytest.approx(sd, rel=1e-7)
    assert out["upper"] - out["lower"] == pytest.approx(4 * sd, rel=1e-7)


def test_p_values_at_many_degrees_of_freedom_meet_the_normal_limit():
    from panelyard.functions.distributions import NORMAL_FROM, normal_two_sided, t_two_sided

    for t in (0.0, 0.5, 1.96, 3.0, 6.0):
        assert abs(float(t_two_sided(t, 1e12)) - normal_two_sided(t)) < 1e-9
        assert abs(float(t_two_sided(t, NORMAL_FROM)) - float(t_two_sided(t, NORMAL_FROM + 1))) < 1e-9


def test_aliased_and_constant_terms(spark):
    rng = np.random.default_rng(5)
    rows = [(float(v), 2.0 * float(v), 7.0, 1.0 + 3.0 * float(v) + float(e)) for v, e in rng.normal(size=(60, 2))]
    df = spark.createDataFrame(rows, "x double, twice double, flat double, y double")
    plain = {r.term: r for r in ols.linear_regression(df, "y ~ x").coefficients.collect()}
    fit = ols.linear_regression(df, "y ~ flat + x + twice")
    full = {r.term: r for r in fit.coefficients.collect()}
    assert full["twice"].estimate is None and full["flat"].p_value is None
    for term in plain:
        np.testing.assert_allclose(
            [full[term].estimate, full[term].std_error], [plain[term].estimate, plain[term].std_error], rtol=1e-8
        )
    fitted = fit.score(df).first()
    np.testing.assert_allclose(fitted["fitted"], full["(Intercept)"].estimate + full["x"].estimate * fitted["x"], rtol=1e-8)
    assert fit.score(df).columns == [*df.columns, "fitted"]
    one = ols.predictive_regression(df, "y", ["x"]).score(df).orderBy("x").collect()
    more = ols.predictive_regression(df, "y", ["flat", "x", "twice"]).score(df).orderBy("x").collect()
    np.testing.assert_allclose([r.est for r in more], [r.est for r in one], rtol=1e-8)
    np.testing.assert_allclose([r.sd for r in more], [r.sd for r in one], rtol=1e-8)


def crossed_data(seed=11, entities=14, regions=5):
    """Entities that lie in several regions, unevenly."""
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(entities, 2)) * [0.9, 0.12], rng.normal(size=(regions, 2)) * [1.1, 0.2]
    rows = []
    for e in range(entities):
        for r in sorted(rng.choice(regions, size=rng.integers(1, 4), replace=False)):
            for t in range(rng.integers(3, 9)):
                c = rng.normal()
                rows.append((f"r{r}", f"g{e}", float(t + 50), c, 20 + 0.4 * t - 0.7 * c + (u[e] + v[r]) @ [1, t] + rng.normal() * 0.5))
    return pd.DataFrame(rows, columns=["r", "g", "t", "c", "y"])


@pytest.mark.parametrize("swap", [False, True])
def test_crossed_effects_equal_dense_reml(spark, swap):
    pdf = crossed_data()
    entity, outer = ("r", "g") if swap else ("g", "r")
    df = spark.createDataFrame(pdf).repartition(3)
    model = fit_mixed(df, "y", ["t", "c"], entity, ["t"], outer=outer, crossed=True)
    assert model.converged and model.effect_keys == [entity]
    value, beta, s2, inverse = dense_criterion(pdf, model, model.theta)
    raw = value + 2 * np.log(model.scales.scale).sum() + (len(pdf) - 3) * 2 * np.log(model.scales.y_scale)
    assert model.criterion == pytest.approx(raw, rel=1e-9)
    np.testing.assert_allclose(model.beta, beta, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(model.inverse, inverse, rtol=1e-5, atol=1e-12)
    assert model.s2 == pytest.approx(s2, rel=1e-8)
    for i in range(len(model.theta)):
        for h in (-0.02, 0.02):
            moved = model.theta.copy()
            moved[i] += h
            assert dense_criterion(pdf, model, moved)[0] > value - 1e-7
    # Effects and predictions by the dense formulas.
    x, z, v, y = dense_parts(pdf, model)
    rest = np.linalg.solve(v, y - x @ beta)
    fitted = x @ beta
    for key, lower, frame in zip((entity, outer), model.shape.lowers(model.theta), (model.effects(), model.outer_effects())):
        got = {r[key]: np.array(r["u"]) for r in frame.collect()}
        for label in pdf[key].unique():
            mine = (pdf[key] == label).to_numpy()
            dense = lower @ lower.T @ z[mine].T @ rest[mine]
            np.testing.assert_allclose(got[label], dense, rtol=1e-5, atol=1e-8)
            fitted[mine] += z[mine] @ dense
    scored = predict.predict(model, spark.createDataFrame(pdf.reset_index())).toPandas().sort_values("index")
    np.testing.assert_allclose(scored["predicted"], fitted * model.scales.y_scale + model.scales.y_shift, rtol=1e-7)
    new = predict.predict(model, spark.createDataFrame([("x", "x", 51.0, 0.0)], "g string, r string, t double, c double")).first()
    est = {r["term"]: r["estimate"] for r in model.coefficients().collect()}
    assert new["predicted"] == pytest.approx(est["(Intercept)"] + 51 * est["t"], rel=1e-9)
    assert model.group_effects().count() == pdf[entity].nunique()
    with pytest.raises(ValueError, match="crossed"):
        predict.predictive(model, df)
    with pytest.raises(ValueError, match="crossed"):
        save_model(model, shared_path(spark, "crossed"))


def test_an_entity_in_two_outer_groups_is_never_split_silently(spark):
    df = spark.createDataFrame(crossed_data())
    with pytest.raises(ValueError, match="crossed=True"):
        fit_mixed(df, "y", ["t"], "g", outer="r")
    with pytest.raises(ValueError, match="several"):
        fit_glmm(df.withColumn("y", F.floor(F.abs("y"))), "y", ["t"], "g", family="poisson", outer="r")


def test_crossed_fit_of_nested_entities_is_the_nested_fit(spark):
    df = spark.createDataFrame(mixed_data(True))
    one = fit_mixed(df, "y", ["t"], "g", ["t"], outer="r")
    two = fit_mixed(df, "y", ["t"], "g", ["t"], outer="r", crossed=True)
    assert type(one) is type(two)
    np.testing.assert_allclose(one.theta, two.theta, rtol=1e-8)


def test_crossed_fit_limits_its_columns(spark, monkeypatch):
    from panelyard.models import crossed

    monkeypatch.setattr(crossed, "MOST_COLUMNS", 4)
    with pytest.raises(ValueError, match="too many levels"):
        fit_mixed(spark.createDataFrame(crossed_data()), "y", ["t"], "g", outer="r", crossed=True)


@pytest.mark.parametrize("nested", [False, True])
def test_aliased_terms_leave_the_rest_of_a_mixed_model_alone(spark, nested):
    pdf = mixed_data(nested).assign(flat=3.0)
    pdf["both"] = 2 * pdf["t"] - pdf["c"]
    df, outer = spark.createDataFrame(pdf), "r" if nested else None
    plain = fit_mixed(df, "y", ["t", "c"], "g", ["t"], outer=outer)
    model = fit_mixed(df, "y", ["flat", "t", "c", "both"], "g", ["t"], outer=outer)
    assert model.converged and model.aliased == ["flat", "both"]
    got = {r["term"]: r for r in model.coefficients().collect()}
    assert list(got) == ["(Intercept)", "flat", "t", "c", "both"]
    assert got["flat"]["estimate"] is None and got["both"]["std_error"] is None
    for row in plain.coefficients().collect():
        assert got[row["term"]]["estimate"] == pytest.approx(row["estimate"], rel=1e-7)
        assert got[row["term"]]["std_error"] == pytest.approx(row["std_error"], rel=1e-6)
    assert model.criterion == pytest.approx(plain.criterion, rel=1e-10)
    again = load_model(spark, save_model(model, shared_path(spark, "aliased")))
    assert again.coefficients().where("estimate is null").count() == 2
    total = predict.predict(again, df).agg(F.sum("predicted")).first()[0]
    assert total == pytest.approx(predict.predict(plain, df).agg(F.sum("predicted")).first()[0], rel=1e-9)
    with pytest.raises(ValueError, match="random slopes"):
        fit_mixed(df, "y", ["t", "c", "both"], "g", ["both"], outer=outer)


def test_aliased_terms_of_count_models(spark):
    pdf = count_data()
    pdf["twice"] = 2 * pdf["t"]
    df = spark.createDataFrame(pdf)
    plain = fit_glmm(df, "c", ["t"], "g", family="poisson", method="laplace")
    model = fit_glmm(df, "c", ["t", "twice"], "g", family="poisson", method="laplace")
    np.testing.assert_allclose(model.beta, plain.beta, rtol=1e-6)
    assert [r["term"] for r in model.coefficients().where("estimate is null").collect()] == ["twice"]


def test_infinite_values_are_named(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, float("-inf")), ("b", 1.0, 2.0)], "g string, t double, y double")
    with pytest.raises(ValueError, match="y has infinite"):
        fit_mixed(df, "y", ["t"], "g")
    with pytest.raises(ValueError, match="y has infinite"):
        fit_glmm(df.selectExpr("g", "y as t", "t as y").withColumnRenamed("t", "y2").withColumnRenamed("y", "t").withColumnRenamed("y2", "y"), "t", ["y"], "g")


def test_an_unconverged_fit_warns(spark):
    df = spark.createDataFrame(mixed_data())
    with pytest.warns(RuntimeWarning, match="has not converged"):
        assert not fit_mixed(df, "y", ["t", "c"], "g", ["t"], max_steps=1).converged


def dense_laplace(pdf, model, phi, y, size):
    """-log L of the whole fit by a mode search per group on the plain rows."""
    m = model.shape.per_level
    lower, beta, s, binomial = factor(phi[:m], model.shape.r), phi[m:], model.scales, model.family == "binomial"
    x = np.column_stack([np.ones(len(pdf)), *[(pdf[t] - a) / k for t, a, k in zip(model.terms, s.shift, s.scale)]])
    total = 0.0
    for rows in pdf.groupby("g").indices.values():
        xi, zi, yi, u = x[rows], x[rows][:, model.shape.z] @ lower, y[rows], np.zeros(model.shape.r)
        for _ in range(60):
            eta = xi @ beta + zi @ u
            mu = size / (1 + np.exp(-eta)) if binomial else np.exp(eta)
            weight = mu * (1 - mu / size) if binomial else mu
            curve = zi.T @ (weight[:, None] * zi) + np.eye(len(u))
            u = u - np.linalg.solve(curve, u - zi.T @ (yi - mu))
        like = yi * eta - (size * np.log1p(np.exp(eta)) if binomial else np.exp(eta))
        total += 0.5 * u @ u - like.sum() + 0.5 * np.linalg.slogdet(curve)[1]
    return total


@pytest.mark.parametrize(("family", "response", "random"), [("binomial", "k", []), ("binomial", "k", ["t"]), ("poisson", "c", ["t"])])
def test_laplace_fit_equals_the_dense_one(spark, family, response, random):
    pdf = count_data()
    if family == "binomial":  # few trials, where quasi-likelihood is biased
        pdf["k"] = np.random.default_rng(3).binomial(2, pdf["k"] / 100)
    df, size = spark.createDataFrame(pdf).repartition(3), 2.0
    model = fit_glmm(df, response, ["t"], "g", random, family, trials=size, method="laplace", rows_per_chunk=10)
    quasi = fit_glmm(df, response, ["t"], "g", random, family, trials=size)
    assert model.converged and model.extra["method"] == "laplace"
    y, phi = pdf[response].to_numpy(float), np.concatenate([model.theta, model.beta])
    value = dense_laplace(pdf, model, phi, y, size)
    assert model.criterion / 2 == pytest.approx(value, rel=1e-9)
    for i in range(len(phi)):
        e = np.zeros(len(phi))
        e[i] = 1e-4
        up, down = dense_laplace(pdf, model, phi + e, y, size), dense_laplace(pdf, model, phi - e, y, size)
        assert abs(up - down) / 2e-4 < 0.05
        assert min(up, down) > value - 1e-6
    assert value < dense_laplace(pdf, model, np.concatenate([quasi.theta, quasi.beta]), y, size)
    if family == "binomial" and not random:
        assert abs(model.theta[0]) > abs(quasi.theta[0])  # quasi-likelihood is biased low
    # The effects of the stored model are the modes.
    effect = {r["g"]: r["u"] for r in model.effects().collect()}
    again = {r["g"]: r["_b"] for r in model.groups.collect()}
    for g, u in effect.items():
        np.testing.assert_allclose(u, again[g], atol=2e-4)


def nested_counts():
    rng = np.random.default_rng(21)
    rows = []
    for r in range(8):
        v = rng.normal() * 0.6
        for e in range(7):
            u, w = rng.normal() * 0.4, rng.normal() * 0.03
            for t in range(15):
                rate = np.exp(1.2 + (0.05 + w) * (t - 7) + u + v)
                rows.append((f"r{r}", f"g{r}_{e}", float(t), rng.poisson(rate), rng.poisson(rate * rng.gamma(5, 1 / 5))))
    return pd.DataFrame(rows, columns=["r", "g", "t", "c", "nb"])


@pytest.mark.parametrize(("family", "response", "random"), [("poisson", "c", ["t"]), ("negbinomial", "nb", [])])
def test_nested_count_models_equal_the_dense_penalised_step(spark, family, response, random):
    """At the fit, the dense mixed-model equations of the working response give the same coefficients and effects, and
    their likelihood has its optimum at the fitted covariance factors."""
    pdf = nested_counts()
    df = spark.createDataFrame(pdf).repartition(3)
    model = fit_glmm(df, response, ["t"], "g", random, family, outer="r", tolerance=1e-5, rows_per_chunk=6)
    assert model.converged
    s = model.scales
    x = np.column_stack([np.ones(len(pdf)), (pdf["t"] - s.shift[0]) / s.scale[0]])
    z = x[:, model.shape.z]
    eta = predict.predict(model, spark.createDataFrame(pdf.reset_index()), kind="link").toPandas().sort_values("index")["predicted"].to_numpy()
    mu, y = np.exp(eta), pdf[response].to_numpy(float)
    weight = mu**2 / (mu + mu**2 / model.extra["nb_theta"]) if family == "negbinomial" else mu
    zeta = eta + (y - mu) / mu

    def value(theta):
        v = np.diag(1 / weight)
        for key, lower in zip(("g", "r"), model.shape.lowers(theta)):
            same = pdf[key].to_numpy()[:, None] == pdf[key].to_numpy()[None, :]
            v += (z @ lower @ lower.T @ z.T) * same
        w = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ w @ x, x.T @ w @ zeta)
        return np.linalg.slogdet(v)[1] + (zeta - x @ beta) @ w @ (zeta - x @ beta), beta

    best, beta = value(model.theta)
    np.testing.assert_allclose(model.beta, beta, rtol=1e-4, atol=1e-6)
    for i in range(len(model.theta)):
        for h in (-0.02, 0.02):
            moved = model.theta.copy()
            moved[i] += h
            assert value(moved)[0] > best - 1e-4
    assert np.sqrt(model.random_covariance()[1][0, 0]) == pytest.approx(0.6, abs=0.35)


def test_a_step_moves_effects_and_sums_only(spark):
    """The plan of a step reads the rows from their buckets: no exchange between the scan and the sums per task."""
    from panelyard.models.glmm import CHUNK, Bucketed, Family, spread_hot, step_sums

    df = spark.createDataFrame(count_data()).select("g", F.col("c").cast("double").alias("_y"), F.lit(1.0).alias("_size"), F.col("t").alias("_t1"))
    table = Bucketed.write(spread_hot(df, "g", 10), ["g"])
    effects = table.rows.groupBy("g").agg((F.max(CHUNK) + 1).alias("_chunks")).withColumns({n: F.array(F.lit(0.1)) for n in ("_u", "_b")})
    family = Family("poisson", [F.lit(1.0), F.col("_t1")], [0])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mu, eta = family.predictor(np.array([0.1, 0.2]))
        out = step_sums(table.with_effects(effects.checkpoint()), ["g"], family, mu, eta, third=True, moved=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scan) == 1 and "Bucketed: true" in scan[0]
    depth = plan.splitlines().index(scan[0])
    above = plan.splitlines()[:depth]
    # Exchanges above the scan: partial sums per entity; the effects' own one is on the other side of the join.
    path, indent = [], scan[0].index("FileScan")
    for line in reversed(above):
        at = len(line) - len(line.lstrip(" :+-"))
        if at < indent:
            path.append(line)
            indent = at
    join = next(i for i, line in enumerate(path) if "ShuffledHashJoin" in line)
    assert not any("Exchange" in line for line in path[:join])
    assert sum("Exchange" in line for line in path[join:]) == 1
    assert out.agg(F.sum("_rows")).first()[0] == 1500
    table.forget()


def test_both_versions_of_the_binomial_r2(spark):
    pdf = count_data()
    df = spark.createDataFrame(pdf)
    model = fit_glmm(df, "k", ["t"], "g", family="binomial", trials=100.0, method="laplace")
    null = fit_glmm(df, "k", [], "g", family="binomial", trials=100.0, method="laplace")
    rows = {r["version"]: r for r in evaluate.explained_variance(model, df, null).collect()}
    one = evaluate.explained_variance(model, df).first()
    assert rows["theoretical"]["r2_conditional"] == pytest.approx(one["r2_conditional"], rel=1e-12)
    eta, spread = null.coefficients().first()["estimate"], float(null.random_covariance()[0][0, 0])
    eta -= 0.5 * spread * np.tanh(eta * (1 + 2 * np.exp(-0.5 * spread)) / 6)
    share = 1 / (1 + np.exp(-eta))
    # The correction brings the intercept close to the mean share of all trials.
    assert share == pytest.approx(pdf["k"].mean() / 100, abs=0.02)
    delta = rows["delta"]
    assert delta["var_residual"] == pytest.approx(1 / (share * (1 - share)), rel=1e-9)
    total = delta["var_fixed"] + delta["var_random"] + delta["var_residual"]
    assert delta["r2_marginal"] == pytest.approx(delta["var_fixed"] / total, rel=1e-9)
    with pytest.raises(ValueError, match="binomial"):
        evaluate.explained_variance(fit_mixed(df.withColumn("y", F.col("t") * 2.0), "t", [], "g"), df, null)
