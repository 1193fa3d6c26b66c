"""Regression and mixed models on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.categories import dummy_columns
from panelyard.functions.numeric import safe_log
from panelyard.models import evaluate, ols, predict
from panelyard.models.glmm import fit_glmm
from panelyard.models.lmm import fit_mixed
from panelyard.models.store import load_model, save_model
from panelyard.operators import panel as p
from panelyard.operators import scale
from panelyard.operators.aggregate import mean_squared_error
from panelyard.plans.composites import exposed_panel
from panelyard.plans.registry import query
from panelyard.plans.tables import PANEL_SQL, order_panel, rounded, table, text_date
from panelyard.session import cut_lineage, shared_path


def prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount"
    )


# Least squares with two predictors, written out through covariances.
_TWO = """WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
    covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_discount, l_discount) AS s22,
    covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y,
    covar_pop(l_extendedprice, l_extendedprice) AS syy FROM lineitem),
  b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
  e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM b),
  fit AS (SELECT 'l_quantity' AS term, b1 AS estimate, sqrt(s2 * s22 / (n * (s11 * s22 - s12 * s12))) AS std_error FROM e
    UNION ALL SELECT 'l_discount', b2, sqrt(s2 * s11 / (n * (s11 * s22 - s12 * s12))) FROM e
    UNION ALL SELECT '(Intercept)', b0, sqrt(s2 / n * (1 + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (s11 * s22 - s12 * s12))) FROM e)"""


@query("m1_linear_regression", f"{_TWO} SELECT term, round(estimate, 3) AS estimate, round(std_error, 3) AS std_error FROM fit")
def linear_regression(spark, sf_dir):
    fit = ols.linear_regression(prices(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount")
    return fit.coefficients.select("term", rounded("estimate", 3), rounded("std_error", 3))


_SLOPES = """WITH g AS (SELECT l_returnflag AS f, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
    FROM lineitem GROUP BY 1), base AS (SELECT a AS a0, b AS b0 FROM g WHERE f = 'A')
  SELECT term, round(estimate, 3) AS estimate FROM (
    SELECT '(Intercept)' AS term, a0 AS estimate FROM base UNION ALL SELECT 'l_quantity', b0 FROM base
    UNION ALL SELECT 'l_returnflag_' || f, a - a0 FROM g, base WHERE f <> 'A'
    UNION ALL SELECT 'l_quantity:l_returnflag_' || f, b - b0 FROM g, base WHERE f <> 'A')"""


@query("m1_interactions", _SLOPES)
def interactions(spark, sf_dir):
    rows = dummy_columns(prices(spark, sf_dir), "l_returnflag", ["A", "N", "R"])
    fit = ols.linear_regression(
        rows,
        "l_extendedprice ~ l_quantity + l_returnflag_N + l_returnflag_R + l_quantity:l_returnflag_N + l_quantity:l_returnflag_R",
    )
    return fit.coefficients.select(F.replace("term", F.lit("_N_"), F.lit("_N")).alias("term"), rounded("estimate", 3))


@query("m2_categorical_slopes", _SLOPES)
def categorical_slopes(spark, sf_dir):
    fit = ols.factor_regression(
        prices(spark, sf_dir), "l_extendedprice", ["l_quantity"], {"l_returnflag": ["A", "N", "R"]}
    )
    return fit.select("term", rounded("estimate", 3))


_PER_SUPPLIER = """WITH g AS (SELECT l_suppkey, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_sxx(l_extendedprice, l_quantity) AS sxx,
    regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1)"""


@query(
    "m3_regression_per_entity",
    f"""{_PER_SUPPLIER} SELECT l_suppkey, 'l_quantity' AS term, round(b, 3) AS estimate, round(sqrt((syy - b * sxy) / (n - 2) / sxx), 3) AS std_error,
        round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 3) AS statistic, n, n - 2 AS df FROM g""",
)
def regression_per_entity(spark, sf_dir):
    fits = ols.grouped_regression(prices(spark, sf_dir), "l_suppkey", "l_extendedprice", ["l_quantity"])
    slopes = ols.grouped_term(fits, "l_quantity")
    return slopes.select(
        "l_suppkey", "term", rounded("estimate", 3), rounded("std_error", 3), rounded("statistic", 3), "n", "df"
    )


# The difference of the two slopes of each supplier, and the t distribution of whole degrees of freedom as its finite
# series in the angle atan(t / sqrt(df)).
_DIFFERENCES = """WITH g AS (SELECT l_suppkey, l_returnflag = 'R' AS late, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b,
    regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy
    FROM lineitem GROUP BY 1, 2),
  w AS (SELECT l_suppkey, CAST(sum(n) - 4 AS BIGINT) AS df, sum(CASE WHEN late THEN b ELSE -b END) AS estimate,
    sqrt(sum(syy - b * sxy) / (sum(n) - 4) * sum(1 / sxx)) AS std_error FROM g GROUP BY 1),
  a AS (SELECT *, atan(abs(estimate / std_error) / sqrt(df)) AS x FROM w),
  k AS (SELECT *, unnest(range(0, df // 2)) AS k FROM a),
  s AS (SELECT l_suppkey, df, estimate, x, sum(CASE WHEN df % 2 = 0 THEN exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * power(cos(x), 2 * k) * sin(x)
    ELSE sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * power(cos(x), 2 * k + 1) * sin(x) END) AS part FROM k GROUP BY ALL),
  p AS (SELECT l_suppkey, estimate, 1 - CASE WHEN df % 2 = 0 THEN part ELSE 2 / pi() * (x + part) END AS p_value FROM s),
  o AS (SELECT *, row_number() OVER (ORDER BY p_value, l_suppkey) AS rn, count(*) OVER () AS n FROM p)
  SELECT l_suppkey, round(estimate, 4) AS estimate, round(p_value, 8) AS p_value,
    round(least(1, max((n - rn + 1) * p_value) OVER (ORDER BY p_value, l_suppkey ROWS UNBOUNDED PRECEDING)), 8) AS adjusted FROM o"""


@query("m3_adjusted_p_values", _DIFFERENCES)
def adjusted_p_values(spark, sf_dir):
    rows = prices(spark, sf_dir).withColumn("late", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    fits = ols.grouped_regression(rows, "l_suppkey", "l_extendedprice", ["l_quantity", "late", "l_quantity:late"])
    return ols.grouped_term(fits, "l_quantity:late").select(
        "l_suppkey", rounded("estimate", 4), rounded("p_value", 8), rounded("adjusted", 8)
    )


def log_prices(spark, sf_dir):
    lines = prices(spark, sf_dir).withColumn("log_price", safe_log("l_extendedprice"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # The supplier side is small next to the lines; Spark checks its size and broadcasts it when it is.
    places = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("s_nationkey").alias("nation_id"), F.col("n_regionkey").alias("region_id")
    )
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")


def model_summary(model):
    """Coefficients and variance components in one long table."""
    levels = model.random_covariance()
    rows = [("residual variance", model.residual_variance())]
    for name, matrix in zip(["entity", "outer"], levels):
        rows += [(f"{name} variance {i}", float(matrix[i, i])) for i in range(len(matrix))]
    extra = model.spark.createDataFrame(rows, "term string, estimate double")
    return model.coefficients().select("term", "estimate").unionByName(extra).select("term", rounded("estimate", 5))


@query("m4_mixed_model")
def mixed_model(spark, sf_dir):
    return model_summary(
        fit_mixed(log_prices(spark, sf_dir), "log_price", ["l_quantity", "l_discount"], "l_suppkey", ["l_quantity"])
    )


def balanced(spark, sf_dir):
    """All lines as mean prices per customer nation, return flag and line number: 21 cells in every nation. Levels
    differ by nation, and ``sloped`` changes with the line number at a rate that differs by region."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cells = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "l_returnflag", (F.col("l_linenumber") - 4).alias("k"))
        .agg((F.avg("l_extendedprice") / 10000 + F.col("c_nationkey") / 10).alias("y"))
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = cells.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return named.select(
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "k", "y",
        (F.col("y") + F.col("n_regionkey") / 10 * F.col("k")).alias("sloped"),
    )


# Balanced one-way layout: REML equals the analysis-of-variance estimates.
_BALANCED = f"""WITH {PANEL_SQL}, t AS (
    SELECT n_name AS nation, r_name AS region, l_linenumber - 4 AS k, avg(l_extendedprice) / 10000 + n_nationkey / 10.0 AS y,
           avg(l_extendedprice) / 10000 + n_nationkey / 10.0 + n_regionkey / 10.0 * (l_linenumber - 4) AS sloped
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY n_name, r_name, n_nationkey, n_regionkey, l_returnflag, l_linenumber),
  g AS (SELECT nation, avg(y) AS gy, count(*) AS n, var_pop(y) * count(*) AS ss FROM t GROUP BY 1),
  a AS (SELECT avg(gy) AS m, max(n) AS n, count(*) AS groups, sum(ss) / (sum(n) - count(*)) AS mse, max(n) * var_samp(gy) AS msb FROM g),
  v AS (SELECT *, (msb - mse) / n AS d FROM a)"""


@query(
    "m4_balanced_layout",
    f"""{_BALANCED} SELECT term, round(x, 5) AS estimate FROM (SELECT '(Intercept)' AS term, m AS x FROM v
        UNION ALL SELECT 'entity variance 0', d FROM v UNION ALL SELECT 'residual variance', mse FROM v)""",
)
def balanced_layout(spark, sf_dir):
    return model_summary(fit_mixed(balanced(spark, sf_dir), "y", [], "nation"))


# Every nation has the same design, so its own least-squares line is all there is to know of it: the fixed effects
# are the mean line, and the lines' sample covariance is that of the random effects and of the estimation together.
_BALANCED_SLOPES = f"""{_BALANCED}, line AS (SELECT nation, regr_intercept(sloped, k) AS a, regr_slope(sloped, k) AS b,
    regr_syy(sloped, k) - regr_sxy(sloped, k) * regr_sxy(sloped, k) / regr_sxx(sloped, k) AS rss, count(*) AS n, regr_sxx(sloped, k) AS sxx
    FROM t GROUP BY 1),
  s AS (SELECT avg(a) AS a, avg(b) AS b, sum(rss) / sum(n - 2) AS s2, var_samp(a) AS da, var_samp(b) AS db, max(n) AS n, max(sxx) AS sxx FROM line)
  SELECT term, round(x, 5) AS estimate FROM (SELECT '(Intercept)' AS term, a AS x FROM s UNION ALL SELECT 'k', b FROM s
    UNION ALL SELECT 'entity variance 0', da - s2 / n FROM s UNION ALL SELECT 'entity variance 1', db - s2 / sxx FROM s
    UNION ALL SELECT 'residual variance', s2 FROM s)"""


@query("m4_balanced_slopes", _BALANCED_SLOPES)
def balanced_slopes(spark, sf_dir):
    return model_summary(fit_mixed(balanced(spark, sf_dir), "sloped", ["k"], "nation", ["k"]))


# A term that another one determines has no estimate and changes nothing for the rest.
@query("m4_balanced_aliased", f"{_BALANCED_SLOPES} UNION ALL SELECT 'twice', NULL")
def balanced_aliased(spark, sf_dir):
    rows = balanced(spark, sf_dir).withColumn("twice", 2 * F.col("k") + 1)
    return model_summary(fit_mixed(rows, "sloped", ["k", "twice"], "nation", ["k"]))


@query("m5_nested_mixed_model")
def nested_mixed_model(spark, sf_dir):
    return model_summary(
        fit_mixed(log_prices(spark, sf_dir), "log_price", ["l_quantity"], "l_suppkey", ["l_quantity"], outer="nation_id")
    )


# Balanced nested layout; a negative area component is set to zero and pooled with the next level, as REML does.
_NESTED = f"""{_BALANCED}, gr AS (SELECT DISTINCT nation, region, gy, n, ss FROM g JOIN (SELECT DISTINCT nation, region FROM t) USING (nation)),
  rr AS (SELECT region, avg(gy) AS ry, count(*) AS k, sum((gy - (SELECT avg(b.gy) FROM gr b WHERE b.region = gr.region)) * (gy - (SELECT avg(b.gy) FROM gr b WHERE b.region = gr.region))) AS sn FROM gr GROUP BY 1),
  ms AS (SELECT a.m, a.n, a.mse, max(k) AS k, count(*) AS areas, a.groups, a.n * sum(sn) AS ssn, a.n * max(k) * var_samp(ry) * (count(*) - 1) AS ssr
         FROM rr, a GROUP BY a.m, a.n, a.mse, a.groups),
  c AS (SELECT *, ssr / (areas - 1) AS msr, ssn / (groups - areas) AS msn FROM ms),
  comp AS (SELECT m, mse, CASE WHEN msr > msn THEN (msr - msn) / (n * k) ELSE 0 END AS dr,
         CASE WHEN msr > msn THEN (msn - mse) / n ELSE ((ssr + ssn) / (groups - 1) - mse) / n END AS de FROM c)"""


@query(
    "m5_balanced_nested_layout",
    f"""{_NESTED} SELECT term, round(x, 5) AS estimate FROM (SELECT '(Intercept)' AS term, m AS x FROM comp
        UNION ALL SELECT 'entity variance 0', de FROM comp UNION ALL SELECT 'outer variance 0', dr FROM comp
        UNION ALL SELECT 'residual variance', mse FROM comp)""",
)
def balanced_nested_layout(spark, sf_dir):
    return model_summary(fit_mixed(balanced(spark, sf_dir), "y", [], "nation", outer="region"))


@query("m5b_nested_new_counts")
def nested_new_counts(spark, sf_dir):
    rows = exposed_panel(spark, sf_dir).withColumn("y", safe_log("new_placed"))
    return model_summary(fit_mixed(rows, "y", ["exposure"], "nation", ["exposure"], outer="region", crossed=True))


def two_way(spark, sf_dir):
    """Mean prices per customer nation, return flag and line number, with levels of the nations and of the flags."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    level = F.col("c_nationkey") / 10 + (F.ascii("l_returnflag") % 7) / 3
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation"), F.col("l_returnflag").alias("flag"), "l_linenumber")
        .agg((F.avg("l_extendedprice") / 10000).alias("price"), F.first(level).alias("level"))
        .select("nation", "flag", (F.col("price") + F.col("level")).alias("y"))
    )


# Balanced two-way layout without interaction: REML equals the analysis-of-variance estimates.
_TWO_WAY = """WITH t AS (SELECT c_nationkey AS nation, l_returnflag AS flag,
      avg(l_extendedprice) / 10000 + c_nationkey / 10.0 + (ascii(l_returnflag) % 7) / 3.0 AS y
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, l_returnflag, l_linenumber),
  s AS (SELECT count(*) AS n, avg(y) AS m, count(DISTINCT nation) AS a, count(DISTINCT flag) AS b, var_pop(y) * count(*) AS ss FROM t),
  e AS (SELECT var_samp(y) AS v FROM (SELECT avg(y) AS y FROM t GROUP BY nation)),
  f AS (SELECT var_samp(y) AS v FROM (SELECT avg(y) AS y FROM t GROUP BY flag)),
  q AS (SELECT m, n, a, b, n / a * e.v AS mse_a, n / b * f.v AS mse_b,
      (ss - n / a * e.v * (a - 1) - n / b * f.v * (b - 1)) / (n - a - b + 1) AS mse FROM s, e, f)"""


@query(
    "m5b_crossed_layout",
    f"""{_TWO_WAY} SELECT term, round(x, 5) AS estimate FROM (SELECT '(Intercept)' AS term, m AS x FROM q
        UNION ALL SELECT 'entity variance 0', (mse_a - mse) / (n / a) FROM q
        UNION ALL SELECT 'outer variance 0', (mse_b - mse) / (n / b) FROM q UNION ALL SELECT 'residual variance', mse FROM q)""",
)
def crossed_layout(spark, sf_dir):
    """Nations and return flags cross: every nation lies in every flag."""
    return model_summary(fit_mixed(two_way(spark, sf_dir), "y", [], "nation", outer="flag", crossed=True))


@query("m5b_crossed_prices")
def crossed_prices(spark, sf_dir):
    """All lines: suppliers, and the flags their lines lie in, with slopes of the quantity for both."""
    rows = log_prices(spark, sf_dir)
    return model_summary(
        fit_mixed(rows, "log_price", ["l_quantity"], "l_suppkey", ["l_quantity"], outer="l_returnflag", crossed=True)
    )


def training_panel(panel):
    """Rows with new orders, last 21 per nation, as the forecast is trained."""
    rows = p.recent_active_window(panel, "nation", "new_placed", "exposure", 21)
    return rows.withColumn("log_placed", safe_log("placed"))


@query("m6_mixed_forecast")
def mixed_forecast(spark, sf_dir):
    """The forecast end to end: panel, training window, fit, grid, predictive interval."""
    panel = cut_lineage(exposed_panel(spark, sf_dir))  # read by the fit's two passes and by the grid
    model = fit_mixed(training_panel(panel), "log_placed", ["exposure"], "nation", ["exposure"])
    grid = p.forecast_grid(panel, "nation", "day", "exposure", keep=["region"])
    out = predict.with_interval(predict.predictive(model, grid))
    return out.select(
        "nation", "region", text_date("day"), "exposure", *[rounded(c, 5) for c in ("est", "sd", "lower", "upper")]
    )


@query(
    "m6_balanced_forecast",
    f"""{_BALANCED} SELECT nation, round(m + d * n / (d * n + mse) * (gy - m), 6) AS est,
          round(sqrt(mse + d * mse / (d * n + mse) + (mse / (d * n + mse)) * (mse / (d * n + mse)) * (d + mse / n) / groups), 6) AS sd
        FROM g, (SELECT m, d, mse, groups FROM v)""",
)
def balanced_forecast(spark, sf_dir):
    rows = balanced(spark, sf_dir)
    model = fit_mixed(rows, "y", [], "nation")
    return predict.predictive(model, rows.select("nation").distinct()).select("nation", rounded("est", 6), rounded("sd", 6))


_SIMPLE = """WITH f AS (SELECT count(*) AS n, avg(o_totalprice) AS my, avg(c_acctbal) AS mx, regr_slope(o_totalprice, c_acctbal) AS b,
    regr_sxx(o_totalprice, c_acctbal) AS sxx, regr_syy(o_totalprice, c_acctbal) AS syy, regr_sxy(o_totalprice, c_acctbal) AS sxy
    FROM orders JOIN customer ON o_custkey = c_custkey),
  s AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM f),
  q AS (SELECT c_custkey, my + b * (c_acctbal - mx) AS est, sqrt(s2 * (1 + 1.0 / n + (c_acctbal - mx) * (c_acctbal - mx) / sxx)) AS sd FROM customer, s)"""


def priced_customers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


@query("m7_predictive_regression", f"{_SIMPLE} SELECT c_custkey, round(est, 3) AS est, round(sd, 3) AS sd FROM q")
def predictive_regression(spark, sf_dir):
    fit = ols.predictive_regression(priced_customers(spark, sf_dir), "o_totalprice", ["c_acctbal"])
    out = fit.score(table(spark, sf_dir, "customer"))
    return out.select("c_custkey", rounded("est", 3), rounded("sd", 3))


def returned_lines(spark, sf_dir):
    """Lines and returned lines per supplier and year, with the mean quantity."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.avg("l_quantity").alias("quantity"),
    )
    return scale.zscore(scale.offset_from(sums, "year", "year_c"), {"quantity_z": "quantity"})


@query("m8_binomial_mixed_model")
def binomial_mixed_model(spark, sf_dir):
    model = fit_glmm(
        returned_lines(spark, sf_dir), "returned", ["year_c", "quantity_z"], "l_suppkey", ["year_c"], "binomial", "lines",
        method="laplace",
    )
    return model_summary(model)


def null_model(spark, sf_dir):
    rows = returned_lines(spark, sf_dir)
    return fit_glmm(rows, "returned", [], "l_suppkey", family="binomial", trials="lines", method="laplace")


@query("m9_null_model")
def binomial_null_model(spark, sf_dir):
    return model_summary(null_model(spark, sf_dir))


@query("m10_negative_binomial")
def negative_binomial(spark, sf_dir):
    rows = exposed_panel(spark, sf_dir).filter(F.col("new_placed") > 0)
    return model_summary(fit_glmm(rows, "new_placed", ["exposure"], "nation", family="negbinomial"))


@query("m11_poisson")
def poisson(spark, sf_dir):
    rows = exposed_panel(spark, sf_dir)
    return model_summary(fit_glmm(rows, "new_placed", ["exposure"], "nation", family="poisson"))


@query("m10_random_slope")
def negative_binomial_slope(spark, sf_dir):
    rows = exposed_panel(spark, sf_dir).filter(F.col("new_placed") > 0)
    return model_summary(fit_glmm(rows, "new_placed", ["exposure"], "nation", ["exposure"], "negbinomial"))


@query("m10_nested")
def negative_binomial_nested(spark, sf_dir):
    rows = exposed_panel(spark, sf_dir).filter(F.col("new_placed") > 0)
    return model_summary(fit_glmm(rows, "new_placed", ["exposure"], "nation", family="negbinomial", outer="region"))


@query("m11_random_slope")
def poisson_slope(spark, sf_dir):
    """Counts of returned lines per supplier and year, levels and trends by supplier."""
    rows = returned_lines(spark, sf_dir)
    return model_summary(fit_glmm(rows, "returned", ["year_c"], "l_suppkey", ["year_c"], "poisson", method="laplace"))


# Newton steps of the Poisson likelihood on the deviation of the exposure from its mean.
_POISSON = f"""WITH RECURSIVE {PANEL_SQL}, m AS (SELECT avg(exposure) AS m FROM panel),
  r AS (SELECT CAST(d_placed AS DOUBLE) AS y, (exposure - m) / 1000.0::DOUBLE AS x FROM panel, m),
  fit(i, a, b) AS (SELECT 0, ln(avg(y)), 0.0::DOUBLE FROM r UNION ALL
    SELECT i + 1, a + (i11 * u0 - i01 * u1) / (i00 * i11 - i01 * i01), b + (i00 * u1 - i01 * u0) / (i00 * i11 - i01 * i01)
    FROM (SELECT i, a, b, sum(y - exp(a + b * x)) AS u0, sum(x * (y - exp(a + b * x))) AS u1, sum(exp(a + b * x)) AS i00,
        sum(x * exp(a + b * x)) AS i01, sum(x * x * exp(a + b * x)) AS i11 FROM fit, r WHERE i < 12 GROUP BY i, a, b)),
  e AS (SELECT a, b, sum(exp(a + b * x)) AS i00, sum(x * exp(a + b * x)) AS i01, sum(x * x * exp(a + b * x)) AS i11
    FROM fit, r WHERE i = 12 GROUP BY a, b),
  v AS (SELECT a, b / 1000 AS b, i11 / (i00 * i11 - i01 * i01) AS va, i00 / (i00 * i11 - i01 * i01) / 1e6 AS vb,
    -i01 / (i00 * i11 - i01 * i01) / 1e3 AS c, m FROM e, m)
  SELECT 'exposure' AS term, round(b, 5) AS estimate, round(sqrt(vb), 5) AS std_error FROM v
  UNION ALL SELECT '(Intercept)', round(a - b * m, 5), round(sqrt(va - 2 * m * c + m * m * vb), 5) FROM v"""


@query("m11_poisson_fixed", _POISSON)
def poisson_fixed(spark, sf_dir):
    fit = ols.poisson_regression(exposed_panel(spark, sf_dir), "new_placed ~ exposure")
    return fit.coefficients.select("term", rounded("estimate", 5), rounded("std_error", 5))


@query(
    "m12_predict_unseen",
    f"""{_BALANCED} SELECT nation, round(m + d * n / (d * n + mse) * (gy - m), 6) AS predicted FROM g, (SELECT m, d, mse FROM v)
        UNION ALL SELECT r_name, round(m, 6) FROM region, v""",
)
def predict_unseen(spark, sf_dir):
    rows = balanced(spark, sf_dir)
    model = fit_mixed(rows, "y", [], "nation")
    places = rows.select("nation").distinct().unionByName(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("nation"))
    )
    return predict.predict(model, places).select("nation", rounded("predicted", 6))


@query(
    "m13_fitted_and_residuals",
    f"""{_BALANCED}, e AS (SELECT t.nation, t.y, m + d * g.n / (d * g.n + mse) * (gy - m) AS f FROM t JOIN g USING (nation), (SELECT m, d, mse FROM v))
        SELECT nation, count(*) AS n, round(max(f), 6) AS fitted, round(sum((y - f) * (y - f)), 4) AS rss FROM e GROUP BY 1""",
)
def fitted_and_residuals(spark, sf_dir):
    rows = balanced(spark, sf_dir)
    out = predict.residuals(fit_mixed(rows, "y", [], "nation"), rows)
    return out.groupBy("nation").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("fitted"), 6).alias("fitted"),
        F.round(F.sum(F.col("residual") * F.col("residual")), 4).alias("rss"),
    )


@query(
    "m14_coefficient_bounds",
    f"""{_TWO} SELECT term, round(estimate, 3) AS estimate, round(estimate - 2 * std_error, 3) AS lower,
        round(estimate + 2 * std_error, 3) AS upper FROM fit""",
)
def coefficient_bounds(spark, sf_dir):
    fit = ols.linear_regression(prices(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount")
    return fit.coefficients.select("term", rounded("estimate", 3), rounded("lower", 3), rounded("upper", 3))


@query(
    "m15_interval_forecast",
    f"""{_SIMPLE} SELECT c_custkey, round(est / 1e6, 6) AS est, round((est - 2 * sd) / 1e6, 6) AS lower, round((est + 2 * sd) / 1e6, 6) AS upper,
        round(exp(est / 1e6), 6) AS est_level FROM q""",
)
def interval_forecast(spark, sf_dir):
    rows = priced_customers(spark, sf_dir).withColumn("millions", F.col("o_totalprice") / 1e6)
    fit = ols.predictive_regression(rows, "millions", ["c_acctbal"])
    out = predict.back_transformed(predict.with_interval(fit.score(table(spark, sf_dir, "customer"))))
    return out.select("c_custkey", *[rounded(c, 6) for c in ("est", "lower", "upper", "est_level")])


_HOLDOUT = """WITH o AS (SELECT year(o_orderdate) AS y, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey),
  f AS (SELECT regr_slope(o_totalprice, c_acctbal) AS b, regr_intercept(o_totalprice, c_acctbal) AS a FROM o WHERE y <> (SELECT max(y) FROM o)),
  h AS (SELECT o_totalprice, a + b * c_acctbal AS fit FROM o, f WHERE y = (SELECT max(y) FROM o))"""


@query(
    "m16_holdout_last_year",
    """SELECT CASE WHEN year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) THEN 'test' ELSE 'train' END AS part,
       count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1""",
)
def holdout_last_year(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice", F.year("o_orderdate").alias("year"))
    train, test = evaluate.holdout_latest(rows, "year")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"))


@query(
    "m17_holdout_error",
    f"{_HOLDOUT} SELECT round(avg((o_totalprice - fit) * (o_totalprice - fit)) / 1e6, 4) AS mse, count(*) AS n FROM h",
)
def holdout_error(spark, sf_dir):
    rows = priced_customers(spark, sf_dir).withColumn("year", F.year("o_orderdate"))
    train, test = evaluate.holdout_latest(rows, "year")
    scored = ols.linear_regression(train, "o_totalprice ~ c_acctbal").score(test)
    out = mean_squared_error(scored, "o_totalprice", "fitted")
    return out.select(F.round(F.col("mse") / 1e6, 4).alias("mse"), "n")


@query("m18_explained_variance")
def explained_variance(spark, sf_dir):
    rows = log_prices(spark, sf_dir)
    model = fit_mixed(rows, "log_price", ["l_quantity"], "l_suppkey", ["l_quantity"])
    out = evaluate.explained_variance(model, rows)
    return out.select(*[rounded(c, 6) for c in out.columns])


@query("m18_binomial_versions")
def binomial_versions(spark, sf_dir):
    """Both versions of the binomial R2 of the returned lines; the second needs the null model."""
    rows = returned_lines(spark, sf_dir)
    model = fit_glmm(rows, "returned", ["year_c", "quantity_z"], "l_suppkey", family="binomial", trials="lines", method="laplace")
    out = evaluate.explained_variance(model, rows, null_model(spark, sf_dir))
    return out.select("version", *[rounded(c, 5) for c in out.columns if c != "version"])


@query(
    "m18_balanced_layout",
    f"""{_BALANCED} SELECT 0.0::DOUBLE AS var_fixed, round(d, 5) AS var_random, round(mse, 5) AS var_residual, 0.0::DOUBLE AS r2_marginal,
        round(d / (d + mse), 5) AS r2_conditional FROM v""",
)
def balanced_explained_variance(spark, sf_dir):
    rows = balanced(spark, sf_dir)
    out = evaluate.explained_variance(fit_mixed(rows, "y", [], "nation"), rows)
    return out.select(*[rounded(c, 5) for c in out.columns])


@query(
    "s14_saved_model",
    f"""{_BALANCED} SELECT nation, round(m + d * n / (d * n + mse) * (gy - m), 6) AS predicted FROM g, (SELECT m, d, mse FROM v)""",
)
def saved_model(spark, sf_dir):
    """Fit, save, load, and predict with the loaded model."""
    rows = balanced(spark, sf_dir)
    loaded = load_model(spark, save_model(fit_mixed(rows, "y", [], "nation"), shared_path(spark, "model")))
    return predict.predict(loaded, rows.select("nation").distinct()).select("nation", rounded("predicted", 6))


@query(
    "m19_actual_vs_forecast",
    f"""{_BALANCED}, s AS (SELECT nation, m + d * n / (d * n + mse) * (gy - m) AS est,
          sqrt(mse + d * mse / (d * n + mse) + (mse / (d * n + mse)) * (mse / (d * n + mse)) * (d + mse / n) / groups) AS sd FROM g, (SELECT m, d, mse, groups FROM v)),
        l AS (SELECT nation, max(exposure) AS x, max(day) AS last FROM panel GROUP BY 1)
        SELECT nation, CAST(day AS VARCHAR) AS day, 'observed' AS kind, CAST(placed AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM panel
        UNION ALL SELECT nation, CAST(last + CAST(k AS INTEGER) AS VARCHAR), 'forecast', round(exp(est), 2), round(exp(est - 2 * sd), 2), round(exp(est + 2 * sd), 2)
        FROM s JOIN l USING (nation), (SELECT unnest(range(1, 22)) AS k)""",
)
def actual_vs_forecast(spark, sf_dir):
    model = fit_mixed(balanced(spark, sf_dir), "y", [], "nation")
    grid = p.forecast_grid(exposed_panel(spark, sf_dir), "nation", "day", "exposure", mode="dense")
    forecast = predict.with_interval(predict.predictive(model, grid))
    out = p.actual_vs_forecast(order_panel(spark, sf_dir), forecast, "nation", "day", "placed")
    return out.select("nation", text_date("day"), "kind", *[rounded(c, 2) for c in ("value", "lower", "upper")])


@query(
    "m20_group_effects",
    f"""{_BALANCED} SELECT nation, round(d * n / (d * n + mse) * (gy - m), 6) AS effect FROM g, (SELECT m, d, mse FROM v)""",
)
def group_effects(spark, sf_dir):
    model = fit_mixed(balanced(spark, sf_dir), "y", [], "nation")
    return model.group_effects().select("nation", rounded("(Intercept)", 6, "effect"))
