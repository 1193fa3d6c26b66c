"""What a user calls: whole-panel metrics, totals, snapshots, training windows and forecast grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.numeric import active_level, per_population, ratio, safe_log
from panelyard.operators import windows as w
from panelyard.operators.aggregate import group_means, totals_by
from panelyard.operators.clean import derive, drop_incomplete
from panelyard.operators.joins import left_join
from panelyard.operators.keys import Rules, recode, without_entities


def collapse_to_key(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum rows that share a key (several reporting units of one entity), so the panel key is unique."""
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def panel_metrics(
    df: DataFrame,
    entity: str,
    time: str,
    total: str,
    removed: Sequence[str],
    fatal: str | None = None,
    population: str | None = None,
    per: float = 100_000,
    pop_unit: float = 1,
    scan: bool = False,
) -> DataFrame:
    """Active level, daily changes, fatality ratio, rates, logs and exposure of a cumulative panel.

    ``total`` minus the ``removed`` levels is ``active``; ``new_*`` are changes since the row before;
    ``*_per_pop`` are per ``per`` persons. One shuffle and one sort serve every column.
    """
    levels = [total, *removed]
    rows = df.withColumn("active", active_level(total, removed))
    every = [*levels, "active"]
    out = w.with_previous(rows, entity, time, every, scan).withColumns(
        {**{f"new_{c}": w.change(c) for c in every}, "exposure": w.exposure_days(time)}
    )
    extra = {f"log_{c}": safe_log(c) for c in every}
    if fatal:
        extra["fatality"] = ratio(fatal, total)
    if population:
        for c in [*every, *[f"new_{c}" for c in levels]]:
            extra[f"{c}_per_pop"] = per_population(c, population, per, pop_unit)
    return out.withColumns(extra).drop("_previous", w.START)


def totals_over_time(
    df: DataFrame, time: str, total: str, removed: Sequence[str], scan: bool = False
) -> DataFrame:
    """Totals of all entities per date, their changes, the active level and logs."""
    levels = [total, *removed]
    sums = totals_by(df, time, levels).withColumn("active", active_level(total, removed))
    every = [*levels, "active"]
    out = w.series_deltas(sums, time, {f"new_{c}": c for c in every}, scan)
    return out.withColumns({f"log_{c}": safe_log(c) for c in every})


def latest_snapshot(metrics: DataFrame, time: str) -> DataFrame:
    return w.latest_rows(metrics, time)


def recent_active_window(
    df: DataFrame, entity: str, change: str, order: str, n: int, banned: Sequence[str] = ()
) -> DataFrame:
    """Rows of a panel with a positive change, without listed entities, last ``n`` per entity."""
    rows = df.filter(F.col(change) > 0)
    return w.recent_n(without_entities(rows, entity, banned) if banned else rows, entity, order, n, unique=True)


def forecast_grid(
    df: DataFrame,
    entity: str,
    time: str,
    exposure: str,
    horizon: int = 21,
    keep: Sequence[str] = (),
    mode: str = "observed",
) -> DataFrame:
    """Future (entity, date, exposure) rows with the columns of ``keep``.

    ``observed`` shifts the first ``horizon`` observed exposure days beyond the last one, so an entity with
    gaps or a short history gets fewer rows. ``dense`` gives every entity all ``horizon`` days, with ``keep``
    taken from its last row.
    """
    if mode == "observed":
        early = df.filter(F.col(exposure) <= horizon).select(entity, exposure, *keep).distinct()
        last = df.groupBy(entity).agg(F.max(exposure).alias("last_exposure"), F.max(time).alias("last_time"))
        rows = left_join(early, last, entity)
        step = F.col(exposure)
    elif mode == "dense":
        last = df.groupBy(entity).agg(
            F.max(exposure).alias("last_exposure"),
            F.max(time).alias("last_time"),
            *[F.max_by(k, time).alias(k) for k in keep],
        )
        rows = last.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        step = F.col("_step")
    else:
        raise ValueError("mode is 'observed' or 'dense'")
    return rows.select(
        entity,
        (step + F.col("last_exposure")).alias(exposure),
        F.date_add("last_time", step.cast("int")).alias(time),
        "last_exposure",
        "last_time",
        *keep,
    )


def assemble_covariates(
    panel: DataFrame,
    covariates: DataFrame,
    population: DataFrame,
    entity: str,
    covariate_entity: str,
    covariate_region: str,
    columns: Sequence[str],
    population_entity: str,
    population_value: str,
    covariate_rules: Rules = (),
    population_rules: Rules = (),
) -> DataFrame:
    """Panel + per-entity means of the covariates + population, after name reconciliation."""
    means = recode(
        group_means(covariates, [covariate_entity, covariate_region], columns), covariate_entity, covariate_rules
    ).drop(covariate_region)
    people = recode(population.select(population_entity, population_value), population_entity, population_rules)
    joined = left_join(panel, means, {entity: covariate_entity})
    return left_join(joined, people, {entity: population_entity})


def policy_panel(
    panel: DataFrame,
    policy: DataFrame,
    doses: DataFrame,
    entity: str,
    time: str,
    policy_key: tuple[str, str],
    doses_key: tuple[str, str],
) -> DataFrame:
    """Panel joined to policy levels and vaccination totals on entity and date."""
    joined = left_join(panel, policy, {entity: policy_key[0], time: policy_key[1]}, null_keys=False)
    return left_join(joined, doses, {entity: doses_key[0], time: doses_key[1]}, null_keys=False)


def feature_table(
    spine: DataFrame,
    parts: Sequence[DataFrame],
    keys: Sequence[str],
    derived: Mapping[str, Column] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Left-join measure tables onto an (entity, year) spine, add derived columns, keep rows whose required
    columns are all present."""
    out = spine
    for part in parts:
        out = left_join(out, part, keys, null_keys=False)
    out = derive(out, derived or {})
    return drop_incomplete(out, required) if required else out


def actual_vs_forecast(
    observed: DataFrame, forecast: DataFrame, entity: str, time: str, value: str, est: str = "est",
    lower: str = "lower", upper: str = "upper", back: bool = True,
) -> DataFrame:
    """Observed and forecast series stacked for plotting; ``back`` takes a log-scale forecast to the level."""
    f = F.exp if back else (lambda c: c)
    past = observed.select(
        entity, time, F.lit("observed").alias("kind"), F.col(value).cast("double").alias("value"),
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
    )
    ahead = forecast.select(
        entity, time, F.lit("forecast").alias("kind"), f(F.col(est)).alias("value"),
        f(F.col(lower)).alias("lower"), f(F.col(upper)).alias("upper"),
    )
    return past.unionByName(ahead)
