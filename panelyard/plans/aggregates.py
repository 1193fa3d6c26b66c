"""Aggregates, sorts and histograms on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import aggregate as a
from panelyard.operators.panel import panel_metrics
from panelyard.plans.registry import query
from panelyard.plans.tables import LEVELS, PANEL_SQL, order_panel, table, text_date


@query(
    "a1_group_means",
    """SELECT d.lang, d.source, round(avg(l.quality), 6) AS quality, round(avg(l.toxic), 6) AS toxic,
              round(avg(d.n_chars), 4) AS n_chars, count(*) AS nrows
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""",
)
def group_means(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    means = a.group_means(rows, ["lang", "source"], ["quality", "toxic", "n_chars"])
    return means.select(
        "lang", "source", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"),
        F.round("n_chars", 4).alias("n_chars"), "nrows",
    )


@query(
    "a2_group_sums",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, round(sum(l_quantity), 2) AS quantity,
              round(sum(l_extendedprice), 2) AS price, round(sum(l_discount), 2) AS discount, round(sum(l_tax), 2) AS tax
       FROM lineitem GROUP BY 1, 2""",
)
def group_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    sums = a.group_sums(rows, ["year", "l_returnflag"], names)
    return sums.select("year", "l_returnflag", *[F.round(n, 2).alias(n) for n in names])


@query(
    "a3_scaled_sums_long",
    """WITH s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) / 1e6 AS price, sum(l_quantity) / 1e6 AS quantity
                  FROM lineitem GROUP BY 1)
       SELECT year, 'price' AS variable, round(price, 6) AS value, 0 AS variable_order FROM s
       UNION ALL SELECT year, 'quantity', round(quantity, 6), 1 FROM s""",
)
def scaled_sums_long(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    long = a.sums_by_area(rows, "year", {"price": "l_extendedprice", "quantity": "l_quantity"})
    return long.withColumn("value", F.round("value", 6))


@query(
    "a4_daily_totals",
    f"""WITH {PANEL_SQL} SELECT CAST(day AS VARCHAR) AS day, CAST(sum(placed) AS BIGINT) AS placed,
        CAST(sum(finished) AS BIGINT) AS finished, CAST(sum(open) AS BIGINT) AS open FROM panel GROUP BY 1""",
)
def daily_totals(spark, sf_dir):
    totals = a.totals_by(order_panel(spark, sf_dir), "day", LEVELS)
    return totals.select(text_date("day"), *LEVELS)


@query(
    "a5_kpi_totals",
    f"""WITH {PANEL_SQL} SELECT CAST(sum(placed) AS BIGINT) AS placed, CAST(sum(finished) AS BIGINT) AS finished,
        CAST(sum(open) AS BIGINT) AS open, CAST(max(day) AS VARCHAR) AS last_date,
        CAST((SELECT max(day) - min(day) FROM panel) AS INTEGER) AS days_covered
        FROM panel WHERE day = (SELECT max(day) FROM panel)""",
)
def kpi_totals(spark, sf_dir):
    kpi = a.kpi_totals(order_panel(spark, sf_dir), "day", LEVELS)
    return kpi.withColumn("last_date", F.col("last_date").cast("string"))


@query(
    "a5_kpi_levels_and_changes",
    f"""WITH {PANEL_SQL} SELECT CAST(sum(placed) AS BIGINT) AS placed, CAST(sum(finished) AS BIGINT) AS finished, CAST(sum(open) AS BIGINT) AS open,
        CAST(sum(placed - finished - open) AS BIGINT) AS active, CAST(sum(d_placed) AS BIGINT) AS new_placed,
        CAST(sum(d_finished) AS BIGINT) AS new_finished, CAST(sum(d_open) AS BIGINT) AS new_open,
        CAST(sum(d_placed - d_finished - d_open) AS BIGINT) AS new_active, CAST(max(day) AS VARCHAR) AS last_date,
        CAST((SELECT max(day) - min(day) FROM panel) AS INTEGER) AS days_covered
        FROM panel WHERE day = (SELECT max(day) FROM panel)""",
)
def kpi_levels_and_changes(spark, sf_dir):
    """All four levels at the last date, and by how much each changed since the entities' rows before."""
    levels = [*LEVELS, "active"]
    metrics = panel_metrics(order_panel(spark, sf_dir), "nation", "day", "placed", ["finished", "open"])
    kpi = a.kpi_totals(metrics, "day", [*levels, *[f"new_{c}" for c in levels]])
    return kpi.withColumn("last_date", F.col("last_date").cast("string"))


@query(
    "a6_entity_kpi",
    f"""WITH {PANEL_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed, finished, open,
        CAST(exposure - 1 AS INTEGER) AS days_since_first FROM panel WHERE month(day) = 12 AND day(day) = 31""",
)
def entity_kpi(spark, sf_dir):
    panel = order_panel(spark, sf_dir)
    asked = panel.filter((F.month("day") == 12) & (F.dayofmonth("day") == 31)).select("nation", "day")
    out = a.entity_kpi(panel, "nation", "day", LEVELS, asked)
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "a7_global_stats",
    """SELECT round(avg(c_acctbal), 6) AS c_acctbal_mean, round(stddev_samp(c_acctbal), 6) AS c_acctbal_sd,
              min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max FROM customer""",
)
def global_stats(spark, sf_dir):
    s = a.global_stats(table(spark, sf_dir, "customer"), ["c_acctbal"])
    return s.withColumns({c: F.round(c, 6) for c in ("c_acctbal_mean", "c_acctbal_sd")})


@query(
    "a8_mean_squared_error",
    """SELECT c_mktsegment, round(avg((o_totalprice / 1000 - c_acctbal) * (o_totalprice / 1000 - c_acctbal)), 3) AS mse, count(*) AS n
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""",
)
def mean_squared_error(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).withColumn(
        "price", F.col("o_totalprice") / 1000
    )
    out = a.mean_squared_error(rows, "price", "c_acctbal", F.col("c_mktsegment") != "BUILDING", ["c_mktsegment"])
    return out.withColumn("mse", F.round("mse", 3))


@query(
    "a9_draw_summary",
    "SELECT user_id, round(avg(value), 6) AS est, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1",
)
def draw_summary(spark, sf_dir):
    out = a.draw_summary(table(spark, sf_dir, "events"), ["user_id"], "value")
    return out.select("user_id", F.round("est", 6).alias("est"), F.round("sd", 6).alias("sd"))


@query("a10_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, sf_dir):
    return a.distinct_rows(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


_HISTOGRAM = """WITH e AS (SELECT min({v}) AS lo, max({v}) AS hi FROM {t}),
  b AS (SELECT {f} {v}, least(CAST(floor(({v} - lo) / ((hi - lo) / {n})) AS INTEGER) + 1, {n}) AS bin FROM {t}, e),
  c AS (SELECT {f} bin, count(*) AS n FROM b GROUP BY ALL),
  g AS (SELECT {f} CAST(i AS INTEGER) AS bin FROM (SELECT DISTINCT {f} 0 AS z FROM {t}), range(1, {n} + 1) s(i))
  SELECT {f} bin, round(lo + (bin - 1) * ((hi - lo) / {n}), 6) AS lower, round(lo + bin * ((hi - lo) / {n}), 6) AS upper,
    coalesce(c.n, 0) AS n FROM (g LEFT JOIN c USING ({f} bin)) CROSS JOIN e"""


@query("a11_histogram", _HISTOGRAM.format(t="orders", v="o_totalprice", f="", n=30))
def histogram(spark, sf_dir):
    h = a.histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return h.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query("a11_histogram_faceted", _HISTOGRAM.format(t="lineitem", v="l_extendedprice", f="l_returnflag,", n=12))
def histogram_faceted(spark, sf_dir):
    h = a.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 12, ["l_returnflag"])
    return h.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query("o1_sorted", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def sorted_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", "n_regionkey").orderBy(F.col("n_regionkey").desc(), "n_name")


@query("o2_first_value", "SELECT min(p_type) AS p_type FROM part")
def first_value(spark, sf_dir):
    return a.first_value(table(spark, sf_dir, "part"), "p_type")
