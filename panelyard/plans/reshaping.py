"""Wide and long forms on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.models.ols import grouped_regression
from panelyard.operators import reshape
from panelyard.plans.registry import query
from panelyard.plans.tables import SHEET_SQL, YEARLY_SQL, YEARS, rounded, table, yearly_orders

_LONG = " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM part" for c in ("p_size", "p_retailprice")
)


@query("r1_to_long", _LONG)
def to_long(spark, sf_dir):
    return reshape.to_long(
        table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"], "variable", "value", cast="double"
    )


def coverage_sheet(spark, sf_dir):
    """One row per nation and a column ``orders_<year>`` per year, empty where a third of the counts is missing."""
    rows = yearly_orders(spark, sf_dir).withColumn("orders", F.when(F.col("orders") % 3 != 0, F.col("orders")))
    return reshape.to_wide(rows, ["nation"], "year", YEARS, ["orders"], "orders_{name}")


@query(
    "r2_to_long_prefixed",
    f"WITH {SHEET_SQL} SELECT nation, CAST(year AS VARCHAR) AS year, orders FROM sheet",
)
def to_long_prefixed(spark, sf_dir):
    sheet = coverage_sheet(spark, sf_dir)
    return reshape.to_long(sheet, ["nation"], sheet.columns[1:], "year", "orders", names_prefix="orders_")


@query("r3_to_long_multi", f"WITH {YEARLY_SQL} SELECT nation, year, orders, value FROM yearly")
def to_long_multi(spark, sf_dir):
    sheet = reshape.to_wide(
        yearly_orders(spark, sf_dir), ["nation"], "year", YEARS, ["orders", "value"], "{value}_{name}"
    )
    long = reshape.to_long_multi(sheet, ["nation"], sheet.columns[1:], "year", code_type="int")
    return long.filter(F.col("orders").isNotNull())


_TYPES = ["click", "purchase", "view", "error", "signup"]
_PIVOT = ", ".join(
    f"CAST(max(n) FILTER (WHERE event_type = '{t}') AS DOUBLE) AS \"{t}_n\", max(v) FILTER (WHERE event_type = '{t}') AS \"{t}_v\""
    for t in _TYPES
)


@query(
    "r4_to_wide",
    f"""WITH s AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)
        SELECT user_id, {_PIVOT} FROM s GROUP BY 1""",
)
def to_wide(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("value"), 2).alias("v")
    )
    return reshape.to_wide(sums, ["user_id"], "event_type", _TYPES, ["n", "v"], "{name}_{value}")


_INDICATORS = {"Number of orders": "n_orders", "Order value": "order_value"}


@query(
    "r5_transpose_indicators",
    f"""WITH {YEARLY_SQL}, y(year) AS (SELECT unnest(range(1995, 2002))), e AS (SELECT DISTINCT nation FROM yearly)
        SELECT e.nation, CAST(y.year AS INTEGER) AS "Year", CAST(t.orders AS DOUBLE) AS n_orders, t.value AS order_value
        FROM e CROSS JOIN y LEFT JOIN yearly t ON t.nation = e.nation AND t.year = y.year""",
)
def transpose_indicators(spark, sf_dir):
    yearly = yearly_orders(spark, sf_dir)
    # Rows are indicators and columns are years, as spending sheets come.
    long = reshape.to_long(yearly, ["nation", "year"], ["orders", "value"], "indicator", "cell", cast="double").withColumn(
        "indicator", F.when(F.col("indicator") == "orders", "Number of orders").otherwise("Order value")
    )
    sheet = reshape.to_wide(long, ["nation", "indicator"], "year", YEARS, ["cell"], "{name}")
    return reshape.transpose_indicators(sheet, "nation", "indicator", [str(y) for y in YEARS], _INDICATORS)


@query(
    "r6_expand_periods",
    f"""WITH {YEARLY_SQL}, p AS (
          SELECT nation, 1999 AS last, CAST(sum(orders) FILTER (WHERE year BETWEEN 1995 AND 1999) AS DOUBLE) AS total FROM yearly GROUP BY 1
          UNION ALL SELECT nation, 2004, CAST(coalesce(sum(orders) FILTER (WHERE year BETWEEN 2000 AND 2004), 0) AS DOUBLE) FROM yearly GROUP BY 1)
        SELECT nation, CAST(unnest(range(last - 4, last + 1)) AS INTEGER) AS "Year", round(total * 1000 / 5, 4) AS births FROM p""",
)
def expand_periods(spark, sf_dir):
    def period(a, b):
        total = F.sum(F.when(F.col("year").between(a, b), F.col("orders")))
        return F.coalesce(total, F.lit(0)).alias(f"{a}-{b}")

    sheet = yearly_orders(spark, sf_dir).groupBy("nation").agg(period(1995, 1999), period(2000, 2004))
    long = reshape.expand_periods(sheet, "nation", sheet.columns[1:], value="births", unit=1000)
    return long.withColumn("births", F.round("births", 4))


@query(
    "r7_fit_per_group",
    """SELECT l_returnflag, 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS estimate, count(*) AS n FROM lineitem GROUP BY 1
       UNION ALL SELECT l_returnflag, '(Intercept)', round(regr_intercept(l_extendedprice, l_quantity), 4), count(*) FROM lineitem GROUP BY 1""",
)
def fit_per_group(spark, sf_dir):
    fits = grouped_regression(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", ["l_quantity"])
    return fits.select("l_returnflag", "term", rounded("estimate", 4), "n")
