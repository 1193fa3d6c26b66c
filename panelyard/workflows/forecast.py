"""Forecast of cumulative counts: snapshots -> panel -> training window -> mixed model -> 21-day forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.dates import days_since
from panelyard.functions.numeric import ratio, safe_log
from panelyard.models.lmm import MixedModel, fit_mixed
from panelyard.models.predict import predictive, with_interval
from panelyard.operators import clean, panel
from panelyard.operators.keys import keep_entities
from panelyard.operators.windows import deltas
from panelyard.sources import csv
from panelyard.sources.lookups import invert_groups, lookup_column
from panelyard.workflows import fixed_values as v

LEVELS = ["Confirmed", "Deaths", "Recovered"]


def read_panel(spark: SparkSession, old_paths: Sequence[str], new_paths: Sequence[str]) -> DataFrame:
    """Snapshots of both eras as one panel, unique on (country, date), with the region of each country.

    Files that report parts of a country are summed to the country.
    """
    eras = []
    for era, paths in (("old", old_paths), ("new", new_paths)):
        if not paths:
            continue
        header = v.ERA_HEADERS[era]
        rows = csv.read_snapshots(
            spark, paths, {header: "string", **dict.fromkeys(LEVELS, "bigint")}, {header: "country"}, date="date"
        )
        eras.append(keep_entities(rows, "country", invert_groups(v.COUNTRIES_BY_REGION)))
    rows = panel.collapse_to_key(csv.stack_eras(eras), ["country", "date"], LEVELS)
    renamed = rows.withColumnsRenamed({c: c.lower() for c in LEVELS})
    return renamed.withColumn("region", lookup_column("country", invert_groups(v.COUNTRIES_BY_REGION)))


def read_population(spark: SparkSession, path: str, first: int, last: int, unit: float = 1000) -> DataFrame:
    """Yearly population in persons from the long estimates file (thousands)."""
    rows = csv.read_flat(spark, path, {"Location": "string", "Time": "int", "PopTotal": "double"}).distinct()
    kept = rows.filter(F.col("Time").between(first, last))
    return clean.rescale(kept, "PopTotal", unit)


def daily_metrics(counts: DataFrame) -> DataFrame:
    changes = {"new_cases": "confirmed", "new_deaths": "deaths", "new_recoveries": "recovered"}
    return deltas(counts, "country", "date", changes, exposure="exposure").withColumn(
        "days_since", days_since("date", v.DAY_ZERO)
    )


def model_table(counts: DataFrame, covariates: DataFrame, population: DataFrame) -> DataFrame:
    """Daily metrics with covariate means and population; ``population`` has ``Location, PopTotal``."""
    joined = panel.assemble_covariates(
        daily_metrics(counts), covariates, population, "country", "countryorarea", "region", v.COVARIATES,
        "Location", "PopTotal", v.COVARIATE_NAMES, v.POPULATION_NAMES_FORECAST,
    )
    return joined.withColumn("confirmed_scaled", ratio("confirmed", "PopTotal"))


def training_rows(table: DataFrame) -> DataFrame:
    return panel.recent_active_window(
        table, "country", "new_cases", "exposure", v.TRAINING_ROWS, v.LEFT_OUT_OF_TRAINING
    )


def forecast_rows(table: DataFrame, mode: str = "observed") -> DataFrame:
    covariates = [t for t in v.FORECAST_TERMS if t != "exposure"]
    return panel.forecast_grid(table, "country", "date", "exposure", v.HORIZON, ["region", *covariates], mode)


def fit_forecast(training: DataFrame, terms: Sequence[str] = v.FORECAST_TERMS, by_region: bool = False) -> MixedModel:
    """log(confirmed) on exposure and covariates with a random line per country (and per region)."""
    rows = training.withColumn("log_confirmed", safe_log("confirmed"))
    return fit_mixed(rows, "log_confirmed", list(terms), "country", ["exposure"], outer="region" if by_region else None)


def forecast(model: MixedModel, grid: DataFrame) -> DataFrame:
    """Estimate, sd and bounds on the log scale for every complete grid row."""
    rows = with_interval(predictive(model, clean.drop_incomplete(grid)))
    return rows.select("country", "region", "date", "exposure", "est", "sd", "upper", "lower")
