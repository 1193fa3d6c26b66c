"""Scalar functions and rates on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions import categories, dates, numeric, text
from panelyard.plans.registry import query
from panelyard.plans.tables import (
    DAILY_SQL,
    PANEL_SQL,
    POPULATION_SQL,
    YEARLY_SQL,
    daily_orders,
    finite,
    nation_population,
    order_panel,
    rounded,
    table,
    text_date,
    yearly_orders,
)


def dated_orders(spark, sf_dir, pattern):
    """Order dates as text, with every seventh key holding no date."""
    day = F.date_format("o_orderdate", pattern)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "not known").otherwise(day).alias("written")
    )


_PARSED = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"""


@query("f1_parse_month_day_year", _PARSED)
def parse_month_day_year(spark, sf_dir):
    rows = dated_orders(spark, sf_dir, "MM-dd-yyyy")
    return rows.select("o_orderkey", dates.parse_mdy("written").cast("string").alias("day"))


@query("f2_parse_year_month_day", _PARSED)
def parse_year_month_day(spark, sf_dir):
    rows = dated_orders(spark, sf_dir, "yyyy-MM-dd")
    return rows.select("o_orderkey", dates.parse_ymd("written").cast("string").alias("day"))


@query("f3_parse_compact", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def parse_compact(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).alias("code"),
    )
    return rows.select("o_orderkey", dates.parse_compact("code").cast("string").alias("day"))


@query(
    "f4_format_dates",
    "SELECT strftime(o_orderdate, '%m-%d-%Y') || '.csv' AS file, count(*) AS orders FROM orders GROUP BY 1",
)
def format_dates(spark, sf_dir):
    name = F.concat(dates.format_date("o_orderdate"), F.lit(".csv"))
    return table(spark, sf_dir, "orders").groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "f5_shift_days",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) + l_linenumber AS VARCHAR) AS due FROM lineitem",
)
def shift_days(spark, sf_dir):
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", dates.shift_days(day, "l_linenumber").cast("string").alias("due")
    )


@query(
    "f6_days_between",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS days
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def days_between(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.select("l_orderkey", "l_linenumber", dates.days_between("o_orderdate", "l_shipdate").alias("days"))


@query(
    "f7_text_functions",
    r"""SELECT p_partkey, regexp_replace(p_brand, '[[:punct:]]+', '', 'g') AS plain, regexp_replace(p_brand, '^Brand', '') AS tail,
              regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS letters, split_part(p_brand, '#', 2) AS number,
              contains(p_name, 'red') AS is_red, p_brand || '_' || p_type AS glued FROM part""",
)
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.strip_punctuation("p_brand").alias("plain"),
        text.strip_prefix("p_brand", "Brand").alias("tail"),
        text.letters_only("p_brand").alias("letters"),
        text.split_part("p_brand", "#", 1).alias("number"),
        text.contains_text("p_name", "red").alias("is_red"),
        F.concat_ws("_", "p_brand", "p_type").alias("glued"),
    )


@query(
    "f8_log_with_edges",
    f"""WITH {DAILY_SQL} SELECT nation, CAST(day AS VARCHAR) AS day,
        CASE WHEN d_finished - d_open < 0 THEN 'nan' WHEN d_finished = d_open THEN 'minus infinity' ELSE 'finite' END AS kind,
        CASE WHEN d_finished > d_open THEN round(ln(d_finished - d_open), 6) END AS log_value FROM daily""",
)
def log_with_edges(spark, sf_dir):
    rows = daily_orders(spark, sf_dir).withColumn("x", numeric.safe_log(F.col("d_finished") - F.col("d_open")))
    kind = (
        F.when(F.isnan("x"), "nan").when(F.col("x") == F.lit(float("-inf")), "minus infinity").otherwise("finite")
    )
    return rows.select("nation", text_date("day"), kind.alias("kind"), rounded(finite("x"), 6, "log_value"))


@query(
    "f9_exp_and_half_even",
    """SELECT c_custkey, round(exp(c_acctbal / 5000), 6) AS back, round_even(c_custkey / 2.0, 0) AS half FROM customer""",
)
def exp_and_half_even(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        rounded(F.exp(F.col("c_acctbal") / 5000), 6, "back"),
        numeric.round_half_even(F.col("c_custkey").cast("double") / 2).alias("half"),
    )


@query("f10_round_two_digits", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS shown FROM lineitem")
def round_two_digits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.round_half_even(F.col("l_quantity") / 8, 2).alias("shown")
    )


@query(
    "f11_active_level",
    f"WITH {PANEL_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed - finished - open AS active FROM panel",
)
def active_level(spark, sf_dir):
    return order_panel(spark, sf_dir).select(
        "nation", text_date("day"), numeric.active_level("placed", ["finished", "open"]).alias("active")
    )


@query(
    "f12_ratio",
    f"""WITH {DAILY_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, round(CASE WHEN d_open <> 0 THEN d_finished / d_open END, 6) AS ratio
        FROM daily""",
)
def safe_ratio(spark, sf_dir):
    return daily_orders(spark, sf_dir).select(
        "nation", text_date("day"), rounded(numeric.ratio("d_finished", "d_open"), 6, "ratio")
    )


def populated_panel(spark, sf_dir):
    panel, people = order_panel(spark, sf_dir), nation_population(spark, sf_dir)
    return panel.join(people, panel.nation == people.place, "left").drop("place")


_POPULATED = f"WITH {PANEL_SQL}, {POPULATION_SQL}, p AS (SELECT * FROM panel LEFT JOIN population ON nation = place)"


@query(
    "f13_rates_per_population",
    f"""{_POPULATED} SELECT nation, CAST(day AS VARCHAR) AS day, round(placed * 100000.0 / (population * 1000), 6) AS placed_rate,
        round(open * 100000.0 / (population * 1000), 6) AS open_rate FROM p""",
)
def rates_per_population(spark, sf_dir):
    return populated_panel(spark, sf_dir).select(
        "nation",
        text_date("day"),
        rounded(numeric.per_population("placed", "population", pop_unit=1000), 6, "placed_rate"),
        rounded(numeric.per_population("open", "population", pop_unit=1000), 6, "open_rate"),
    )


@query(
    "f14_share_of_population",
    f"{_POPULATED} SELECT nation, CAST(day AS VARCHAR) AS day, round(placed / population, 8) AS share FROM p",
)
def share_of_population(spark, sf_dir):
    return populated_panel(spark, sf_dir).select(
        "nation", text_date("day"), rounded(numeric.ratio("placed", "population"), 8, "share")
    )


@query(
    "f15_log_rates",
    f"""{_POPULATED} SELECT nation, CAST(day AS VARCHAR) AS day, round(ln(d_placed / population), 6) AS log_new,
        round(ln(placed / population), 6) AS log_level FROM p""",
)
def log_rates(spark, sf_dir):
    daily = daily_orders(spark, sf_dir).select("nation", "day", "d_placed")
    rows = populated_panel(spark, sf_dir).join(daily, ["nation", "day"])
    return rows.select(
        "nation",
        text_date("day"),
        rounded(numeric.log_per_head("d_placed", "population"), 6, "log_new"),
        rounded(numeric.log_per_head("placed", "population"), 6, "log_level"),
    )


@query(
    "f16_weighted_share",
    f"""WITH {YEARLY_SQL}, {POPULATION_SQL} SELECT nation, year, round(CAST(0.01 AS DOUBLE) * population * (orders % 101), 4) AS covered
        FROM yearly JOIN population ON nation = place""",
)
def weighted_share(spark, sf_dir):
    yearly, people = yearly_orders(spark, sf_dir), nation_population(spark, sf_dir)
    rows = yearly.join(people, yearly.nation == people.place)
    return rows.select("nation", "year", rounded(numeric.weighted_share(F.col("orders") % 101, "population"), 4, "covered"))


@query(
    "f17_value_per_head",
    f"""WITH {YEARLY_SQL}, {POPULATION_SQL} SELECT nation, year, round(value / population, 4) AS per_head
        FROM yearly JOIN population ON nation = place""",
)
def value_per_head(spark, sf_dir):
    yearly, people = yearly_orders(spark, sf_dir), nation_population(spark, sf_dir)
    rows = yearly.join(people, yearly.nation == people.place)
    return rows.select("nation", "year", rounded(numeric.ratio("value", "population"), 4, "per_head"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query(
    "f18_category_order",
    """SELECT o_orderpriority, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
         WHEN '4-NOT SPECIFIED' THEN 3 END AS DOUBLE) AS place, count(*) AS orders FROM orders GROUP BY 1""",
)
def category_order(spark, sf_dir):
    place = categories.category_order("o_orderpriority", _PRIORITIES).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("place", place)
    )


@query(
    "f19_dummy_columns",
    """SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag_N",
              CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag_R", count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
)
def dummy_columns(spark, sf_dir):
    rows = categories.dummy_columns(table(spark, sf_dir, "lineitem").select("l_returnflag"), "l_returnflag", ["A", "N", "R"])
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
