"""Government response: policy levels and vaccinations next to the panel, and per-country regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.dates import parse_compact
from panelyard.functions.numeric import log_per_head
from panelyard.models.ols import grouped_regression, grouped_term
from panelyard.operators import clean, panel
from panelyard.operators.keys import recode
from panelyard.operators.windows import recent_n
from panelyard.sources import csv
from panelyard.workflows import fixed_values as v


def read_policy(spark: SparkSession, path: str, extra: tuple[str, ...] = ("StringencyIndex",)) -> DataFrame:
    columns = {"CountryName": "string", "Date": "string"}
    columns |= {source: "double" for source, _ in v.POLICY_FLAGS.values()} | dict.fromkeys(extra, "double")
    rows = csv.read_flat(spark, path, columns, null_value="")
    dated = rows.withColumn("Date", parse_compact("Date"))
    return recode(dated, "CountryName", v.POLICY_NAMES)


def read_doses(spark: SparkSession, path: str) -> DataFrame:
    rows = csv.read_flat(spark, path, {"location": "string", "date": "date", "total_vaccinations": "double"}, null_value="")
    return recode(clean.drop_incomplete(rows), "location", v.DOSE_NAMES)


def policy_table(metrics: DataFrame, policy: DataFrame, doses: DataFrame) -> DataFrame:
    """Display panel joined to policy and doses, with 0/1 flags, log rates and the day count."""
    joined = panel.policy_panel(
        metrics, policy, doses.withColumnRenamed("date", "dose_date"), "country", "date", ("CountryName", "Date"), ("location", "dose_date")
    )
    flagged = clean.binarise(joined, v.POLICY_FLAGS)
    return flagged.withColumns(
        {
            "timespan": F.col("exposure"),
            "log_cases_pop": log_per_head("new_confirmed", "PopTotal"),
            "log_confirmed_pop": log_per_head("confirmed", "PopTotal"),
        }
    ).filter(F.col("new_confirmed") > 0)


def recent_policy_rows(table: DataFrame) -> DataFrame:
    return recent_n(table, "country", "exposure", v.POLICY_ROWS, unique=True)


POLICY_TERMS = ["timespan"] + [f"C{i}" for i in range(1, 9)] + [f"C{i}:timespan" for i in range(1, 9)]


def openness_coefficients(recent: DataFrame, term: str = "C7:timespan") -> DataFrame:
    """One regression per country; the chosen term with Holm-adjusted p-values, largest first."""
    return grouped_term(grouped_regression(recent, "country", "log_cases_pop", POLICY_TERMS), term)
