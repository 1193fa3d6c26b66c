"""Vaccine coverage, governance and development tables merged by country and year."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.text import coded_headers
from panelyard.operators import clean, reshape
from panelyard.operators.joins import outer_merge
from panelyard.operators.keys import recode
from panelyard.sources import csv
from panelyard.workflows import fixed_values as v

KEYS = ["Country", "Year"]


def read_coverage(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A wide coverage sheet (title line, then ``Country, 2019, 2018, ...``) as (Country, Year, value)."""
    sheet = csv.read_sheet(spark, path, skip=1, null_value="")
    long = reshape.to_long(sheet, ["Country"], sheet.columns[1:], "Year", value, drop_missing=True, cast="double")
    return long.withColumn("Year", F.col("Year").cast("int"))


def read_governance(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One governance sheet as (Country, Year, Estimate_name, StdErr_name, NumSrc_name)."""
    sheet = csv.read_sheet(spark, path, skip=v.GOVERNANCE_SKIP)
    coded = sheet.toDF(*coded_headers(sheet.columns, v.GOVERNANCE_YEARS, v.GOVERNANCE_COLUMNS_PER_YEAR))
    kept = clean.select_matching(coded, ["Country", *v.GOVERNANCE_MEASURES])
    entity, *cells = kept.columns
    long = reshape.to_long_multi(kept, [entity], cells, "Year", code_type="int").withColumnRenamed(entity, "Country")
    numbers = clean.to_number(long, v.GOVERNANCE_MEASURES)
    return clean.rename_affixed(numbers, v.GOVERNANCE_MEASURES, suffix=name)


def merge_all(coverage: Mapping[str, DataFrame], governance: Mapping[str, DataFrame], development: DataFrame) -> DataFrame:
    """Outer merge of every table on country and year, names reconciled on the way. ``development`` is keyed by
    ``Entity, Year``."""
    covered = recode(outer_merge(list(coverage.values()), KEYS), "Country", v.COVERAGE_NAMES)
    governed = recode(outer_merge(list(governance.values()), KEYS), "Country", v.GOVERNANCE_NAMES)
    both = recode(outer_merge([covered, governed], KEYS), "Country", v.MERGED_NAMES)
    index = recode(development, "Entity", v.DEVELOPMENT_NAMES).withColumnRenamed("Entity", "Country")
    return outer_merge([both, index], KEYS)
