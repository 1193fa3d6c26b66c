"""Vaccination clinics: targets, staff, cost and time for every country and scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import scenario as s
from panelyard.operators.keys import recode
from panelyard.sources import csv
from panelyard.workflows import fixed_values as v


def read_staff(spark: SparkSession, path: str, translators: tuple[float, float] = (1, 2)) -> DataFrame:
    """The staffing sheet per role and clinic type: workers per shift, hand-set cells applied."""
    sheet = csv.read_flat(spark, path, null_value="")
    named = sheet.toDF("Position", "Shift_4Station", "Day_4Station", "Shift_8Station", "Day_8Station", "Experience")
    cells = {
        **v.STAFF_CELLS,
        (v.TRANSLATOR, "four"): translators[0],
        (v.TRANSLATOR, "eight"): translators[1],
    }
    fixed = recode(named, "Position", v.STAFF_NAMES)
    return s.staff_by_type(fixed, "Position", {"four": "Shift_4Station", "eight": "Shift_8Station"}, cells)


def plan(
    population: DataFrame, staff: DataFrame, wages: DataFrame, scenarios: Sequence[s.Scenario], clinics: DataFrame
) -> DataFrame:
    """Everything the calculator shows, one row per country and scenario.

    ``population`` has ``Location, PopTotal`` in thousands, ``clinics`` has ``Location, four, eight``.
    """
    people = s.headcount(clinics, ["Location"], {"four": "four", "eight": "eight"}, staff)
    cost = s.personnel_cost(people, ["Location"], wages)
    rows = s.with_target(s.with_scenarios(population, scenarios), "PopTotal")
    staffed = rows.join(s.with_capacity(clinics, v.CLINIC_DOSES), "Location").join(cost, "Location", "left")
    return s.with_days_to_goal(s.with_costs(staffed))


def even_wages(staff: DataFrame, wage: float = 20) -> DataFrame:
    return staff.select("role").distinct().withColumn("wage", F.lit(float(wage)))
