"""Clinic staffing, cost and time scenarios, evaluated for every area at once.

Scenarios are parameters: a short Python list that becomes an array literal and is exploded next to each row.
Staff tables join on the clinic type, a table of roles times types that Spark broadcasts when it is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import ColumnOrName, as_column, ratio, round_half_even


@dataclass(frozen=True)
class Scenario:
    scenario: str
    percent: float = 80.0
    cost_transport: float = 10_000.0
    cost_dose: float = 20.0
    cost_material: float = 12.0
    doses_bought: float = 1_000.0
    doses_given: float = 0.0


def with_scenarios(df: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items()]) for s in scenarios]
    return df.select("*", F.inline(F.array(*rows)))


def with_target(df: DataFrame, population: ColumnOrName, pop_unit: float = 1000) -> DataFrame:
    """Doses to give: ``percent`` of the population (in thousands by default)."""
    return df.withColumn("target", as_column(population) * F.col("percent") * F.lit(pop_unit / 100))


def with_capacity(df: DataFrame, clinics: Mapping[str, float]) -> DataFrame:
    """``{column with the number of clinics: doses per clinic and day}`` -> ``capacity_<column>`` and their sum."""
    parts = {f"capacity_{c}": F.col(c) * F.lit(rate) for c, rate in clinics.items()}
    out = df.withColumns(parts)
    total = sum((F.col(p) for p in parts), F.lit(0))
    return out.withColumn("capacity", total)


def staff_by_type(
    staff: DataFrame, role: str, columns: Mapping[str, str], overrides: Mapping[tuple[str, str], float] | None = None
) -> DataFrame:
    """``{clinic type: column}`` of a staffing sheet in long form, text such as "On Call" as missing, single
    (role, clinic type) cells replaced by ``overrides``."""
    long = staff.select(
        F.col(role).alias("role"), *[F.col(c).try_cast("double").alias(t) for t, c in columns.items()]
    ).unpivot(["role"], list(columns), "clinic_type", "workers")
    workers = F.col("workers")
    for (r, t), value in (overrides or {}).items():
        workers = F.when((F.col("role") == r) & (F.col("clinic_type") == t), F.lit(float(value))).otherwise(workers)
    return long.withColumn("workers", workers)


def staff_table(staff_long: DataFrame, clinic_type: str) -> DataFrame:
    return staff_long.filter(F.col("clinic_type") == clinic_type).select("role", "workers")


def headcount(areas: DataFrame, ids: Sequence[str], clinics: Mapping[str, str], staff_long: DataFrame) -> DataFrame:
    """People needed per area and role; ``{clinic type: column with the number of clinics}``."""
    long = areas.select(*ids, *[F.col(c).alias(t) for t, c in clinics.items()]).unpivot(
        list(ids), list(clinics), "clinic_type", "n_clinics"
    )
    return (
        long.join(staff_long, "clinic_type")
        .groupBy(*ids, "role")
        .agg(F.sum(F.col("n_clinics") * F.col("workers")).alias("people"))
    )


def personnel_cost(people: DataFrame, ids: Sequence[str], wages: DataFrame, hours: float = 8) -> DataFrame:
    """Hourly wages per role (``role``, ``wage``) times people and hours, summed per area."""
    return (
        people.join(wages, "role", "left")
        .groupBy(*ids)
        .agg((F.sum(F.col("people") * F.col("wage")) * F.lit(hours)).alias("cost_personnel"))
    )


def with_costs(df: DataFrame) -> DataFrame:
    """Material and total cost. The total uses the same personnel cost that is shown on its own line."""
    supplies = F.col("doses_bought") * (F.col("cost_dose") + F.col("cost_material"))
    return df.withColumns(
        {
            "cost_supplies": supplies,
            "cost_total": F.col("cost_transport") + supplies + F.coalesce(F.col("cost_personnel"), F.lit(0.0)),
        }
    )


def with_days_to_goal(df: DataFrame) -> DataFrame:
    """Whole days to give the doses still missing at full capacity."""
    left = F.col("target") - F.col("doses_given")
    return df.withColumn("days_to_goal", round_half_even(ratio(left, "capacity")))


def with_simple_finance(
    df: DataFrame,
    target: str = "target",
    rate: float = 15,
    workers: ColumnOrName = "workers",
    units: ColumnOrName = "units",
    needed: ColumnOrName = "needed",
    store_price: float = 10_000,
    wage: float = 20,
    transport: float = 40_000,
    order: float = 20_000,
) -> DataFrame:
    """The early form of the calculator: time, storage, extra workers, their wages, and the total."""
    storage = as_column(units) * F.lit(float(store_price))
    extra = as_column(needed) - as_column(workers)
    return df.withColumns(
        {
            "days": ratio(target, as_column(workers) * F.lit(float(rate))),
            "cost_storage": storage,
            "extra_workers": extra,
            "cost_wages": extra * F.lit(float(wage)),
            "cost_simple_total": storage + extra * F.lit(float(wage)) + F.lit(float(transport)) + F.lit(float(order)),
        }
    )
