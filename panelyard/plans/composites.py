"""Whole-panel operators on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.dates import parse_compact
from panelyard.functions.numeric import ratio, weighted_share
from panelyard.operators import panel as p
from panelyard.operators import scale, windows
from panelyard.operators.joins import outer_merge
from panelyard.plans.functions import populated_panel
from panelyard.plans.registry import query
from panelyard.plans.tables import (
    LEVELS,
    PANEL_SQL,
    POPULATION_SQL,
    YEARLY_SQL,
    finite,
    nation_population,
    order_panel,
    rounded,
    table,
    text_date,
    user_days,
    user_days_sql,
    yearly_orders,
)

METRICS_SQL = f"""{PANEL_SQL}, {POPULATION_SQL},
metrics AS (
  SELECT nation, region, day, placed, finished, open, placed - finished - open AS active,
         d_placed AS new_placed, d_finished AS new_finished, d_open AS new_open,
         d_placed - d_finished - d_open AS new_active,
         finished / placed AS fatality, exposure, population
  FROM panel LEFT JOIN population ON nation = place)"""


def order_metrics(spark, sf_dir):
    return p.panel_metrics(
        populated_panel(spark, sf_dir),
        "nation", "day", "placed", ["finished", "open"], fatal="finished", population="population", pop_unit=1000,
    )


@query(
    "c1_panel_metrics",
    f"""WITH {METRICS_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, active, new_placed, new_finished, new_open, new_active,
        CAST(exposure AS INTEGER) AS exposure, round(fatality, 6) AS fatality, round(ln(placed), 6) AS log_placed,
        CASE WHEN active > 0 THEN round(ln(active), 6) END AS log_active,
        round(placed * 100.0 / population, 6) AS placed_per_pop, round(active * 100.0 / population, 6) AS active_per_pop,
        round(new_placed * 100.0 / population, 6) AS new_placed_per_pop FROM metrics""",
)
def panel_metrics(spark, sf_dir):
    return order_metrics(spark, sf_dir).select(
        "nation", text_date("day"), "active", "new_placed", "new_finished", "new_open", "new_active", "exposure",
        rounded("fatality", 6), rounded("log_placed", 6), rounded(finite("log_active"), 6, "log_active"),
        rounded("placed_per_pop", 6), rounded("active_per_pop", 6), rounded("new_placed_per_pop", 6),
    )


@query(
    "c2_totals_over_time",
    f"""WITH {PANEL_SQL}, t AS (SELECT day, CAST(sum(placed) AS BIGINT) AS placed, CAST(sum(finished) AS BIGINT) AS finished,
             CAST(sum(open) AS BIGINT) AS open FROM panel GROUP BY 1), u AS (SELECT *, placed - finished - open AS active FROM t)
        SELECT CAST(day AS VARCHAR) AS day, placed, finished, open, active,
               CAST(placed - lag(placed, 1, 0) OVER w AS BIGINT) AS new_placed, CAST(active - lag(active, 1, 0) OVER w AS BIGINT) AS new_active,
               round(ln(placed), 6) AS log_placed FROM u WINDOW w AS (ORDER BY day)""",
)
def totals_over_time(spark, sf_dir):
    out = p.totals_over_time(order_panel(spark, sf_dir), "day", "placed", ["finished", "open"])
    return out.select(
        text_date("day"), *LEVELS, "active", "new_placed", "new_active", rounded("log_placed", 6)
    )


@query(
    "c3_latest_snapshot",
    f"""WITH {METRICS_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed, active, new_placed, new_active
        FROM metrics WHERE day = (SELECT max(day) FROM metrics)""",
)
def latest_snapshot(spark, sf_dir):
    out = p.latest_snapshot(order_metrics(spark, sf_dir), "day")
    return out.select("nation", text_date("day"), "placed", "active", "new_placed", "new_active")


@query(
    "c4_recent_active_window",
    f"""WITH {METRICS_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY nation ORDER BY exposure DESC) AS r FROM metrics
          WHERE new_finished > 0 AND nation NOT IN ('NATION_3', 'NATION_8'))
        SELECT nation, CAST(day AS VARCHAR) AS day, CAST(exposure AS INTEGER) AS exposure, placed FROM k WHERE r <= 21""",
)
def recent_active_window(spark, sf_dir):
    metrics = windows.deltas(
        order_panel(spark, sf_dir), "nation", "day", {"new_finished": "finished"}, exposure="exposure"
    )
    out = p.recent_active_window(metrics, "nation", "new_finished", "exposure", 21, ["NATION_3", "NATION_8"])
    return out.select("nation", text_date("day"), "exposure", "placed")


def exposed_panel(spark, sf_dir):
    return windows.deltas(order_panel(spark, sf_dir), "nation", "day", {"new_placed": "placed"}, exposure="exposure")


@query(
    "c5_forecast_grid_observed",
    f"""WITH {PANEL_SQL}, l AS (SELECT nation, max(exposure) AS last_exposure, max(day) AS last_time FROM panel GROUP BY 1)
        SELECT DISTINCT nation, region, CAST(exposure + last_exposure AS INTEGER) AS exposure, CAST(last_time + CAST(exposure AS INTEGER) AS VARCHAR) AS day,
               CAST(last_exposure AS INTEGER) AS last_exposure FROM panel JOIN l USING (nation) WHERE exposure <= 21""",
)
def forecast_grid_observed(spark, sf_dir):
    grid = p.forecast_grid(exposed_panel(spark, sf_dir), "nation", "day", "exposure", keep=["region"])
    return grid.select("nation", "region", "exposure", text_date("day"), "last_exposure")


@query(
    "c5_forecast_grid_dense",
    f"""WITH {PANEL_SQL}, l AS (SELECT nation, max(region) AS region, max(exposure) AS last_exposure, max(day) AS last_time FROM panel GROUP BY 1)
        SELECT nation, region, CAST(s + last_exposure AS INTEGER) AS exposure, CAST(last_time + CAST(s AS INTEGER) AS VARCHAR) AS day
        FROM l, (SELECT unnest(range(1, 22)) AS s)""",
)
def forecast_grid_dense(spark, sf_dir):
    grid = p.forecast_grid(exposed_panel(spark, sf_dir), "nation", "day", "exposure", keep=["region"], mode="dense")
    return grid.select("nation", "region", "exposure", text_date("day"))


@query(
    "c6_assemble_covariates",
    f"""WITH {PANEL_SQL}, {POPULATION_SQL}, s AS (
          SELECT CASE n_name WHEN 'NATION_6' THEN 'NATION_6B' ELSE n_name END AS country, round(avg(s_acctbal), 4) AS balance
          FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
        SELECT nation, CAST(day AS VARCHAR) AS day, placed, balance, CAST(population AS DOUBLE) AS population
        FROM panel LEFT JOIN s ON nation = country LEFT JOIN population ON nation = place""",
)
def assemble_covariates(spark, sf_dir):
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    covariates = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("country"), F.col("n_regionkey").alias("area"), F.col("s_acctbal").alias("balance")
    )
    people = nation_population(spark, sf_dir).withColumn(
        "place", F.when(F.col("place") == "NATION_2", "Nation Two").otherwise(F.col("place"))
    )
    out = p.assemble_covariates(
        order_panel(spark, sf_dir), covariates, people, "nation", "country", "area", ["balance"], "place", "population",
        covariate_rules=[("NATION_6", "NATION_6A"), ("NATION_6A", "NATION_6B")],
        population_rules=[("Nation Two", "NATION_2")],
    )
    return out.select(
        "nation", text_date("day"), "placed", rounded("balance", 4), F.col("population").cast("double").alias("population")
    )


_TYPES = ("view", "click", "purchase", "error", "signup")


@query(
    "c7_outer_merge",
    f"""WITH {', '.join(user_days_sql(t, t) for t in _TYPES)}
        SELECT user_id, CAST(day AS VARCHAR) AS day, {', '.join(f'CAST({t}s AS DOUBLE) AS {t}s, {t}_value' for t in _TYPES)}
        FROM view_days {' '.join(f'FULL JOIN {t}_days USING (user_id, day)' for t in _TYPES[1:])}""",
)
def merge_outer(spark, sf_dir):
    merged = outer_merge([user_days(spark, sf_dir, t, t) for t in _TYPES], ["user_id", "day"])
    columns = [c for t in _TYPES for c in (F.col(f"{t}s").cast("double").alias(f"{t}s"), F.col(f"{t}_value"))]
    return merged.select("user_id", text_date("day"), *columns)


@query(
    "c8_policy_panel",
    f"""WITH {PANEL_SQL}, policy AS (
          SELECT n_name AS place, CAST(o_orderdate AS DATE) AS day, max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS level
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          WHERE o_orderstatus = 'P' GROUP BY 1, 2),
        doses AS (
          SELECT n_name AS place, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS doses
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
        SELECT nation, CAST(panel.day AS VARCHAR) AS day, placed, CAST(level AS DOUBLE) AS level, doses FROM panel
        LEFT JOIN policy ON nation = policy.place AND panel.day = policy.day
        LEFT JOIN doses ON nation = doses.place AND panel.day = doses.day""",
)
def policy_panel(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    pending = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    # Dates as compact numbers, the way the policy feed writes them.
    code = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    levels = (
        pending.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", code.alias("code"))
        .agg(F.max(F.substring("o_orderpriority", 1, 1).cast("int")).alias("level"))
    )
    policy = levels.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "place", parse_compact("code").alias("when"), "level"
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    shipped = (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "date")
        .agg(F.sum("l_quantity").alias("doses"))
    )
    doses = shipped.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("place").alias("location"), "date", "doses"
    )
    out = p.policy_panel(
        order_panel(spark, sf_dir), policy, doses, "nation", "day", ("place", "when"), ("location", "date")
    )
    return out.select("nation", text_date("day"), "placed", F.col("level").cast("double").alias("level"), "doses")


@query(
    "c9_feature_table",
    f"""WITH {YEARLY_SQL}, {POPULATION_SQL}, staff AS (
          SELECT n_name AS nation, count(*) AS staff FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1),
        aid AS (
          SELECT n_name AS nation, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_discount * l_extendedprice) AS aid
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
        f AS (SELECT y.nation, y.year, y.orders, y.value, CAST(s.staff AS DOUBLE) AS staff, a.aid, CAST(0.01 AS DOUBLE) * population * (orders % 101) AS covered,
                aid / population AS aid_per_head
              FROM yearly y LEFT JOIN staff s ON y.nation = s.nation LEFT JOIN aid a ON y.nation = a.nation AND y.year = a.year
              LEFT JOIN population ON y.nation = place WHERE y.year >= 1996 AND a.aid IS NOT NULL AND staff IS NOT NULL)
        SELECT nation, year, orders, round(covered, 4) AS covered, round(aid_per_head, 3) AS aid_per_head,
               CAST(year - (SELECT min(year) FROM f) AS INTEGER) AS year_c, round(value / 100 - (SELECT avg(value / 100) FROM f), 3) AS value_c
        FROM f""",
)
def feature_table(spark, sf_dir):
    spine = yearly_orders(spark, sf_dir).filter(F.col("year") >= 1996).drop("region")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier")
    staff_counts = suppliers.filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("staff"))
    staff = staff_counts.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("nation", "staff")
    people = nation_population(spark, sf_dir).withColumnRenamed("place", "nation")
    aid_sums = (
        table(spark, sf_dir, "lineitem")
        .join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.year("l_shipdate").alias("year"))
        .agg(F.sum(F.col("l_discount") * F.col("l_extendedprice")).alias("aid"))
    )
    aid = aid_sums.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("nation", "year", "aid")
    by_nation = p.feature_table(spine, [staff, people], ["nation"])
    features = p.feature_table(
        by_nation, [aid], ["nation", "year"],
        derived={"covered": weighted_share(F.col("orders") % 101, "population"), "aid_per_head": ratio("aid", "population")},
        required=["staff", "aid"],
    )
    scaled = scale.centre(scale.offset_from(features, "year", "year_c"), {"value_c": ("value", 0.01)})
    return scaled.select(
        "nation", "year", "orders", rounded("covered", 4), rounded("aid_per_head", 3), "year_c", rounded("value_c", 3)
    )
