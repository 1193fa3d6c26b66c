"""Benchmark tables and the panels the queries share, with the SQL that defines the same panels.

The cumulative panel: per nation and order day the running number of orders placed, finished (status F) and
open (status O). Dates leave a query as text, so both engines print them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators.windows import running_totals


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table with its known schema, so no job reads file footers to find it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def text_date(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def rounded(column: str | Column, digits: int = 4, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits).alias(name or (column if isinstance(column, str) else "value"))


def finite(column: str | Column) -> Column:
    """NULL for NaN and the infinities."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey)
    # Sum per nation key and day first: the name lookup then meets a few rows per nation.
    daily = placed.groupBy("c_nationkey", "day").agg(
        F.count(F.lit(1)).alias("d_placed"),
        F.count_if(F.col("o_orderstatus") == "F").alias("d_finished"),
        F.count_if(F.col("o_orderstatus") == "O").alias("d_open"),
    )
    names = nations(spark, sf_dir)
    return daily.join(names, daily.c_nationkey == names.n_nationkey).select(
        "nation", "region", "day", "d_placed", "d_finished", "d_open"
    )


LEVELS = ("placed", "finished", "open")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_orders(spark, sf_dir)
    return running_totals(daily, "nation", "day", {c: f"d_{c}" for c in LEVELS}).select(
        "nation", "region", "day", *LEVELS
    )


def nation_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    names = nations(spark, sf_dir)
    return customers.join(names, customers.c_nationkey == names.n_nationkey).select(
        F.col("nation").alias("place"), "population"
    )


def yearly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and value per nation and year."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sums = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy("c_nationkey", "year")
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    )
    names = nations(spark, sf_dir)
    return sums.join(names, sums.c_nationkey == names.n_nationkey).select("nation", "region", "year", "orders", "value")


def user_days(spark: SparkSession, sf_dir: str, event_type: str, name: str) -> DataFrame:
    """Events of one type per user and day."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == event_type)
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias(f"{name}s"), F.round(F.sum("value"), 2).alias(f"{name}_value"))
    )


YEARS = list(range(1995, 2002))

DAILY_SQL = """
daily AS (
  SELECT n.n_name AS nation, r.r_name AS region, CAST(o.o_orderdate AS DATE) AS day,
         count(*) AS d_placed,
         count(*) FILTER (WHERE o.o_orderstatus = 'F') AS d_finished,
         count(*) FILTER (WHERE o.o_orderstatus = 'O') AS d_open
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3)"""

PANEL_SQL = (
    DAILY_SQL
    + """,
panel AS (
  SELECT nation, region, day, d_placed, d_finished, d_open,
         CAST(sum(d_placed) OVER w AS BIGINT) AS placed,
         CAST(sum(d_finished) OVER w AS BIGINT) AS finished,
         CAST(sum(d_open) OVER w AS BIGINT) AS open,
         day - min(day) OVER (PARTITION BY nation) + 1 AS exposure
  FROM daily WINDOW w AS (PARTITION BY nation ORDER BY day))"""
)

POPULATION_SQL = """
population AS (
  SELECT n.n_name AS place, count(*) AS population
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1)"""

YEARLY_SQL = """
yearly AS (
  SELECT n.n_name AS nation, r.r_name AS region, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         count(*) AS orders, round(sum(o.o_totalprice), 2) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3)"""

# A sheet has a cell for every nation and year, an empty one where a third of the counts is not reported.
SHEET_SQL = (
    YEARLY_SQL
    + """,
sheet AS (
  SELECT nation, CAST(year AS INTEGER) AS year, CASE WHEN orders % 3 <> 0 THEN orders END AS orders
  FROM (SELECT DISTINCT nation FROM yearly) CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) LEFT JOIN yearly USING (nation, year))"""
)


def user_days_sql(event_type: str, name: str) -> str:
    return f"""
{name}_days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS {name}s, round(sum(value), 2) AS {name}_value
  FROM events WHERE event_type = '{event_type}' GROUP BY 1, 2)"""
