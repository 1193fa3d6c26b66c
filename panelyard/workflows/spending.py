"""Health spending, nurses, births and aid: the yearly feature table and the measles coverage model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.numeric import ratio, safe_log, weighted_share
from panelyard.functions.text import contains_text
from panelyard.models import evaluate, predict
from panelyard.models.glmm import fit_glmm
from panelyard.models.lmm import MixedModel
from panelyard.operators import aggregate, clean, panel, reshape, scale
from panelyard.operators.joins import left_join
from panelyard.operators.keys import keep_entities, recode
from panelyard.sources import csv
from panelyard.workflows import fixed_values as v

NURSES = "Nursing and midwifery personnel (number)"


def read_spending(spark: SparkSession, path: str, indicators: Sequence[str]) -> DataFrame:
    """Indicator rows with a column per year -> one row per (Country, Year), one column per indicator.
    ``indicators`` are the long names in the order of ``SPENDING_VARIABLES``."""
    rows = csv.read_flat(spark, path).select("Countries", "Indicators", *[F.col(f"`{y}`") for y in v.SPENDING_YEARS])
    wide = reshape.transpose_indicators(
        rows.filter(F.col("Countries").isNotNull()), "Countries", "Indicators", v.SPENDING_YEARS, dict(zip(indicators, v.SPENDING_VARIABLES))
    )
    return recode(wide.withColumnRenamed("Countries", "Country"), "Country", v.SPENDING_NAMES)


def read_nurses(spark: SparkSession, path: str) -> DataFrame:
    rows = csv.read_flat(spark, path, {"Country": "string", "Year": "int", NURSES: "double"})
    return recode(rows, "Country", v.NURSE_NAMES)


def read_births(spark: SparkSession, path: str, skip: int = 16) -> DataFrame:
    """Five-year totals in thousands -> yearly averages (Country, Year, Births_Ave)."""
    sheet = csv.read_sheet(spark, path, skip=skip)
    places = sheet.filter(F.col("Type") == "Country/Area")
    periods = [c for c in sheet.columns if c[:4].isdigit() and "-" in c]
    named = places.withColumnRenamed(sheet.columns[2], "Country")
    long = reshape.expand_periods(named, "Country", periods, "Year", "Births_Ave", 5, 1000)
    return recode(long, "Country", v.BIRTH_NAMES)


def read_aid(spark: SparkSession, path: str) -> DataFrame:
    """Aid rows without eliminated channels, money as numbers, missing as 0."""
    money = [*v.CHILD_AID.values(), *v.PANDEMIC_AID.values(), *v.MATERNAL_AID.values()]
    columns = {"year": "int", "source": "string", "channel": "string", "recipient_country": "string",
               "gbd_region": "string", "elim_ch": "int", "prelim_est": "int", **dict.fromkeys(dict.fromkeys(money), "double")}
    rows = csv.read_flat(spark, path, columns)
    return clean.missing_to_zero(rows.filter(F.col("elim_ch") != 1))


def aid_by_country(aid: DataFrame) -> DataFrame:
    """Yearly sums per African recipient: immunisation and pandemic preparation."""
    african = aid.filter(contains_text("gbd_region", "Africa"))
    sums = aggregate.group_sums(african, ["year", "recipient_country"], {**v.CHILD_AID, **v.PANDEMIC_AID})
    named = recode(sums, "recipient_country", v.AID_NAMES)
    return named.select(F.col("recipient_country").alias("Country"), F.col("year").alias("Year"), "Immunization", "PandemicPrep")


def aid_by_area(aid: DataFrame, columns: dict[str, str] = v.CHILD_AID) -> DataFrame:
    """Millions per year and programme area, long, with the plotting order of the areas."""
    return aggregate.sums_by_area(aid, "year", columns)


def feature_rows(
    spending: DataFrame, nurses: DataFrame, merged: DataFrame, births: DataFrame, aid: DataFrame,
    population: DataFrame, countries: DataFrame,
) -> DataFrame:
    """The scaled feature table. ``population`` has ``Location, Time, PopTotal``; ``countries`` lists who stays."""
    keys = ["Country", "Year"]
    spine = keep_entities(spending, "Country", countries)
    known = recode(merged, "Country", v.FEATURE_NAMES)
    rows = panel.feature_table(spine, [nurses, known, births], keys, {
        "LogNurses": safe_log(NURSES),
        "MeaslesPop": weighted_share("pct_Measles1", "Births_Ave"),
    }).drop(NURSES)
    renamed = recode(rows, "Country", v.AFTER_BIRTH_NAMES)
    needed = ["pct_Measles1", "CHEpCapUSD", "Estimate_GovEff", "Estimate_VoiceAcc", "Estimate_PolStab",
              "Estimate_RuleLaw", "Immunization", "PandemicPrep"]
    complete = clean.drop_incomplete(left_join(renamed, aid, keys).select(*needed, *keys))
    scaled = scale.centre(scale.offset_from(complete, "Year", "Year_c"), {"CHEscaled": ("CHEpCapUSD", 0.01)})
    people = recode(population, "Location", v.POPULATION_NAMES_FEATURES)
    joined = left_join(scaled, people, {"Country": "Location", "Year": "Time"})
    return joined.withColumn("ImmunpCap", ratio("Immunization", "PopTotal"))


def model_rows(features: DataFrame, first_year: int = 2000) -> DataFrame:
    rows = features.filter(F.col("Year") >= first_year)
    scored = scale.zscore(rows, {f"{n}_z": f"Estimate_{n}" for n in ("GovEff", "RuleLaw", "PolStab", "VoiceAcc")})
    centred = scale.centre(scored, {"ImmunScaled": ("ImmunpCap", 10_000), "PrepTenMill_c": ("PandemicPrep", 1e-4)})
    return clean.drop_incomplete(centred)


COVERAGE_TERMS = ["CHEscaled", "ImmunScaled", "Year_c", "GovEff_z", "RuleLaw_z", "PolStab_z", "VoiceAcc_z"]


def fit_coverage(train: DataFrame) -> MixedModel:
    return fit_glmm(train, "pct_Measles1", COVERAGE_TERMS, "Country", ["Year_c"], "binomial", 100.0)


def fit_null(train: DataFrame) -> MixedModel:
    return fit_glmm(train, "pct_Measles1", [], "Country", family="binomial", trials=100.0)


def holdout_error(model: MixedModel, rows: DataFrame, left_out: Sequence[str] = ("South Sudan",)) -> DataFrame:
    """Squared error of the predicted share in the last year."""
    _, test = evaluate.holdout_latest(rows, "Year")
    scored = predict.predict(model, test, "predict").withColumn("share", F.col("pct_Measles1") / 100)
    return aggregate.mean_squared_error(scored, "share", "predict", ~F.col("Country").isin(list(left_out)))
