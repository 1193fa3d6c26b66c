"""Tables behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators import panel
from panelyard.operators.aggregate import kpi_totals
from panelyard.operators.joins import geo_join, left_join
from panelyard.operators.keys import recode
from panelyard.operators.windows import deltas
from panelyard.workflows import fixed_values as v

EXPORT_COLUMNS = [
    "country", "date", "confirmed", "active", "recovered", "deaths", "new_confirmed", "new_active", "new_recovered",
    "new_deaths",
]


def display_panel(counts: DataFrame, population: DataFrame, pop_unit: float = 1) -> DataFrame:
    """All per-country metrics; ``population`` has ``Location, PopTotal``."""
    named = recode(counts, "country", v.DISPLAY_NAMES)
    people = recode(population, "Location", v.POPULATION_NAMES_DISPLAY)
    joined = left_join(named, people, {"country": "Location"})
    return panel.panel_metrics(
        joined, "country", "date", "confirmed", ["recovered", "deaths"], fatal="deaths", population="PopTotal",
        pop_unit=pop_unit,
    )


def continent_totals(counts: DataFrame) -> DataFrame:
    return panel.totals_over_time(counts, "date", "confirmed", ["recovered", "deaths"])


def summary_boxes(metrics: DataFrame) -> DataFrame:
    levels = ["confirmed", "active", "recovered", "deaths"]
    return kpi_totals(metrics, "date", levels + [f"new_{c}" for c in levels])


def country_day(metrics: DataFrame, country: str, date: str) -> DataFrame:
    """The boxes of one country and day, with the days since its first record."""
    rows = metrics.filter((F.col("country") == country) & (F.col("date") == F.lit(date).cast("date")))
    return rows.select(*EXPORT_COLUMNS, (F.col("exposure") - 1).alias("days_since_first"))


def country_series(metrics: DataFrame, country: str) -> DataFrame:
    return metrics.filter(F.col("country") == country)


def day_map(features: DataFrame, metrics: DataFrame, metric: str, date: str | None = None) -> DataFrame:
    day = panel.latest_snapshot(metrics, "date") if date is None else metrics.filter(F.col("date") == F.lit(date).cast("date"))
    return geo_join(features, day, "name", "country", metric)


def early_summary(counts: DataFrame) -> DataFrame:
    """The first report page: changes per day and the three levels in long form."""
    changes = {"con_changed": "confirmed", "death_changed": "deaths", "rec_changed": "recovered"}
    rows = deltas(counts, "country", "date", changes)
    return rows.unpivot(["country", "date", *changes], ["confirmed", "deaths", "recovered"], "type", "value")
