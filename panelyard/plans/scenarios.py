"""Staffing and cost scenarios on the benchmark tables.

Areas are nations: customers stand for thousands of people, suppliers for clinics (with or without a positive
balance for the large and the small type), part types for staff roles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import scenario as s
from panelyard.plans.registry import query
from panelyard.plans.tables import POPULATION_SQL, nation_population, nations, rounded, table

SCENARIOS = [
    s.Scenario("base"),
    s.Scenario("high", percent=95.0, doses_bought=250_000.0, doses_given=12_000.0),
    s.Scenario("cheap", percent=70.0, cost_dose=4.5, cost_material=2.0, cost_transport=0.0),
]
CLINICS = {"small": 1900, "large": 5000}

_SCENARIO_SQL = """
scenarios(scenario, percent, cost_transport, cost_dose, cost_material, doses_bought, doses_given) AS (VALUES
  ('base', 80.0::DOUBLE, 10000.0::DOUBLE, 20.0::DOUBLE, 12.0::DOUBLE, 1000.0::DOUBLE, 0.0::DOUBLE),
  ('high', 95.0, 10000.0, 20.0, 12.0, 250000.0, 12000.0),
  ('cheap', 70.0, 0.0, 4.5, 2.0, 1000.0, 0.0))"""
_CLINIC_SQL = """
clinics AS (
  SELECT n_name AS nation, count(*) FILTER (WHERE s_acctbal <= 0) AS small, count(*) FILTER (WHERE s_acctbal > 0) AS large
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""
_STAFF_SQL = """
staff AS (
  SELECT p_type AS role, 'small' AS clinic_type,
         CASE WHEN p_type = 'ECONOMY' THEN 1.0 WHEN p_type = 'PROMO' THEN NULL ELSE CAST(min(p_size) AS DOUBLE) END AS workers FROM part GROUP BY 1
  UNION ALL SELECT p_type, 'large', CAST(max(p_size) AS DOUBLE) FROM part GROUP BY 1),
wages AS (SELECT p_type AS role, round(avg(p_retailprice) / 50, 2) AS wage FROM part GROUP BY 1)"""
_HEADCOUNT_SQL = """
long AS (SELECT nation, 'small' AS clinic_type, small AS n FROM clinics UNION ALL SELECT nation, 'large', large FROM clinics),
people AS (SELECT nation, role, sum(n * workers) AS people FROM long JOIN staff USING (clinic_type) GROUP BY 1, 2),
personnel AS (SELECT nation, sum(people * wage) * 8 AS cost_personnel FROM people JOIN wages USING (role) GROUP BY 1)"""


def clinics(spark, sf_dir):
    counts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.count_if(F.col("s_acctbal") <= 0).alias("small"), F.count_if(F.col("s_acctbal") > 0).alias("large")
    )
    names = nations(spark, sf_dir)
    return counts.join(names, counts.s_nationkey == names.n_nationkey).select("nation", "small", "large")


def staff_sheet(spark, sf_dir):
    """Roles with text cells where nobody is planned, as a staffing sheet has them."""
    return table(spark, sf_dir, "part").groupBy("p_type").agg(
        F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "On Call").otherwise(F.min("p_size").cast("string")).alias("four"),
        F.max("p_size").cast("string").alias("eight"),
    )


def staff(spark, sf_dir):
    return s.staff_by_type(
        staff_sheet(spark, sf_dir), "p_type", {"small": "four", "large": "eight"}, {("ECONOMY", "small"): 1}
    )


def wages(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("role")).agg(
        F.round(F.avg("p_retailprice") / 50, 2).alias("wage")
    )


def targets(spark, sf_dir):
    areas = nation_population(spark, sf_dir).withColumnRenamed("place", "nation")
    return s.with_target(s.with_scenarios(areas, SCENARIOS), "population")


@query(
    "v1_target_doses",
    f"""WITH {POPULATION_SQL}, {_SCENARIO_SQL} SELECT place AS nation, scenario, round(population * percent * 10, 2) AS target
        FROM population, scenarios""",
)
def target_doses(spark, sf_dir):
    return targets(spark, sf_dir).select("nation", "scenario", rounded("target", 2))


@query(
    "v2_daily_capacity",
    f"""WITH {_CLINIC_SQL} SELECT nation, small * 1900 AS capacity_small, large * 5000 AS capacity_large,
        small * 1900 + large * 5000 AS capacity FROM clinics""",
)
def daily_capacity(spark, sf_dir):
    out = s.with_capacity(clinics(spark, sf_dir), CLINICS)
    return out.select("nation", *[F.col(c).cast("bigint").alias(c) for c in ("capacity_small", "capacity_large", "capacity")])


@query(
    "v3_headcount_by_role",
    f"""WITH {_CLINIC_SQL}, {_STAFF_SQL}, {_HEADCOUNT_SQL} SELECT nation, role, round(people, 2) AS people FROM people""",
)
def headcount_by_role(spark, sf_dir):
    people = s.headcount(clinics(spark, sf_dir), ["nation"], {"small": "small", "large": "large"}, staff(spark, sf_dir))
    return people.select("nation", "role", rounded("people", 2))


def personnel(spark, sf_dir):
    people = s.headcount(clinics(spark, sf_dir), ["nation"], {"small": "small", "large": "large"}, staff(spark, sf_dir))
    return s.personnel_cost(people, ["nation"], wages(spark, sf_dir))


@query(
    "v4_personnel_cost",
    f"""WITH {_CLINIC_SQL}, {_STAFF_SQL}, {_HEADCOUNT_SQL} SELECT nation, round(cost_personnel, 2) AS cost_personnel FROM personnel""",
)
def personnel_cost(spark, sf_dir):
    return personnel(spark, sf_dir).select("nation", rounded("cost_personnel", 2))


@query(
    "v5_total_cost",
    f"""WITH {_CLINIC_SQL}, {_STAFF_SQL}, {_HEADCOUNT_SQL}, {POPULATION_SQL}, {_SCENARIO_SQL}
        SELECT place AS nation, scenario, round(doses_bought * (cost_dose + cost_material), 2) AS cost_supplies,
               round(cost_transport + doses_bought * (cost_dose + cost_material) + coalesce(cost_personnel, 0), 2) AS cost_total
        FROM population CROSS JOIN scenarios LEFT JOIN personnel ON place = nation""",
)
def total_cost(spark, sf_dir):
    rows = s.with_costs(targets(spark, sf_dir).join(personnel(spark, sf_dir), "nation", "left"))
    return rows.select("nation", "scenario", rounded("cost_supplies", 2), rounded("cost_total", 2))


@query(
    "v6_days_to_goal",
    f"""WITH {_CLINIC_SQL}, {POPULATION_SQL}, {_SCENARIO_SQL}
        SELECT place AS nation, scenario, round_even((population * percent * 10 - doses_given) / (small * 1900 + large * 5000), 0) AS days_to_goal
        FROM population CROSS JOIN scenarios JOIN clinics ON place = nation""",
)
def days_to_goal(spark, sf_dir):
    rows = targets(spark, sf_dir).join(s.with_capacity(clinics(spark, sf_dir), CLINICS), "nation")
    return s.with_days_to_goal(rows).select("nation", "scenario", "days_to_goal")


@query("v7_staff_table", f"WITH {_STAFF_SQL} SELECT role, workers FROM staff WHERE clinic_type = 'small'")
def staff_table(spark, sf_dir):
    return s.staff_table(staff(spark, sf_dir), "small")


@query(
    "v8_simple_finance",
    f"""WITH {_CLINIC_SQL}, {POPULATION_SQL} SELECT nation, round(population * 800 / (15 * (small + large)), 4) AS days,
        CAST(large * 10000 AS DOUBLE) AS cost_storage, population - (small + large) AS extra_workers,
        CAST((population - (small + large)) * 20 AS DOUBLE) AS cost_wages,
        CAST(large * 10000 + (population - (small + large)) * 20 + 60000 AS DOUBLE) AS cost_simple_total FROM clinics JOIN population ON nation = place""",
)
def simple_finance(spark, sf_dir):
    people = nation_population(spark, sf_dir).withColumnRenamed("place", "nation")
    rows = clinics(spark, sf_dir).join(people, "nation").withColumns(
        {"target": F.col("population") * 800.0, "workers": F.col("small") + F.col("large")}
    )
    out = s.with_simple_finance(rows, units="large", needed="population")
    return out.select(
        "nation", rounded("days", 4), "cost_storage", F.col("extra_workers").cast("bigint").alias("extra_workers"),
        "cost_wages", "cost_simple_total",
    )
