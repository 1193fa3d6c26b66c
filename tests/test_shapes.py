import datetime as dt

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from panelyard.operators import joins, panel, reshape
from panelyard.operators import scenario as s

D = dt.date


def test_left_join_matches_missing_keys_and_suffixes(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "q string, v int")
    once = joins.left_join(left, right, {"k": "q"})
    assert as_set(once, "k", "v_x", "v_y") == {("a", 1, 10), (None, 2, 20)}
    assert as_set(joins.left_join(left, right, {"k": "q"}, null_keys=False), "k", "v_y") == {("a", 10), (None, None)}


def test_outer_merge_equals_join_chain(spark):
    a = spark.createDataFrame([("x", 1, 5.0), ("y", 1, 6.0)], "k string, t int, a double")
    b = spark.createDataFrame([("y", 1, None), ("z", 2, "q")], "k string, t int, b string")
    c = spark.createDataFrame([("x", 1, 9)], "k string, t int, c int")
    chain = joins.full_join(joins.full_join(a, b, ["k", "t"]), c, ["k", "t"])
    columns = ("k", "t", "a", "b", "c")
    assert as_set(joins.outer_merge([a, b, c], ["k", "t"]), *columns) == as_set(chain, *columns)
    with pytest.raises(Exception, match="repeats"):
        joins.outer_merge([a.union(a), b], ["k", "t"]).collect()
    with pytest.raises(ValueError):
        joins.outer_merge([a, a], ["k", "t"])


def test_multi_value_unpivot_splits_at_last_separator(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], ["id", "std_err_1996", "std_err_1998", "est_1998"])
    out = reshape.to_long_multi(df, ["id"], df.columns[1:], "year", code_type="int")
    assert as_set(out, "year", "std_err", "est") == {(1996, 1.0, None), (1998, 2.0, 3.0)}


def test_long_and_back(spark):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 4.0)], "id string, m_1 double, m_2 double")
    long = reshape.to_long(wide, ["id"], ["m_1", "m_2"], "n", "v", names_prefix="m_", drop_missing=True)
    assert as_set(long, "id", "n", "v") == {("a", "1", 1.0), ("b", "1", 3.0), ("b", "2", 4.0)}
    back = reshape.to_wide(long, ["id"], "n", ["1", "2"], ["v"], "m_{name}")
    assert as_set(back, "id", "m_1", "m_2") == as_set(wide, "id", "m_1", "m_2")


def test_indicator_transposition(spark):
    df = spark.createDataFrame(
        [("a", "Long one", "1", "2"), ("a", "Long two", "..", "4")], ["Countries", "Indicators", "2000", "2001"]
    )
    out = reshape.transpose_indicators(df, "Countries", "Indicators", ["2000", "2001"], {"Long one": "one", "Long two": "two"})
    assert as_set(out, "Countries", "Year", "one", "two") == {("a", 2000, 1.0, None), ("a", 2001, 2.0, 4.0)}


def test_period_expansion_conserves_totals(spark):
    df = spark.createDataFrame([("a", 10.0, 5.0)], ["Country", "1950-1955", "1955-1960"])
    out = reshape.expand_periods(df, "Country", ["1950-1955", "1955-1960"], value="v", unit=1000)
    rows = sorted(as_set(out, "Year", "v"))
    assert rows[0] == (1951, 2000.0) and rows[-1] == (1960, 1000.0) and len(rows) == 10
    assert sum(v for _, v in rows) == 15000


@pytest.fixture()
def counts(spark):
    rows = []
    for day in range(1, 31):
        rows.append(("long", D(2020, 3, day), day * 10, day, day * 2, "N"))
        if day in (1, 2, 30):
            rows.append(("gaps", D(2020, 3, day), day, 0, 0, "S"))
    rows.append(("one", D(2020, 3, 30), 4, 1, 0, "S"))
    return spark.createDataFrame(
        rows, "country string, date date, confirmed bigint, deaths bigint, recovered bigint, region string"
    )


def test_panel_metrics(counts):
    people = counts.select("country").distinct().withColumn("pop", F.lit(2.0))
    out = panel.panel_metrics(
        counts.join(people, "country"), "country", "date", "confirmed", ["recovered", "deaths"], fatal="deaths",
        population="pop", pop_unit=1000,
    )
    row = out.filter("country = 'long' and date = '2020-03-05'").first()
    assert (row["active"], row["new_active"], row["new_confirmed"], row["exposure"]) == (35, 7, 10, 5)
    assert row["fatality"] == pytest.approx(0.1) and row["confirmed_per_pop"] == pytest.approx(2500)
    gap = out.filter("country = 'gaps' and date = '2020-03-30'").first()
    assert gap["exposure"] == 30 and gap["new_confirmed"] == 28 and gap["log_deaths"] == float("-inf")


def test_totals_and_snapshot(counts):
    totals = panel.totals_over_time(counts, "date", "confirmed", ["recovered", "deaths"])
    last = totals.filter("date = '2020-03-30'").first()
    assert last["confirmed"] == 334 and last["new_confirmed"] == 44 and last["active"] == 334 - 60 - 31
    assert panel.latest_snapshot(counts, "date").count() == 3


def test_forecast_grids(counts):
    from panelyard.operators.windows import deltas

    rows = deltas(counts, "country", "date", {"new": "confirmed"}, exposure="exposure")
    observed = panel.forecast_grid(rows, "country", "date", "exposure", 21, ["region"])
    per = {r["country"]: r["n"] for r in observed.groupBy("country").agg(F.count("*").alias("n")).collect()}
    assert per == {"long": 21, "gaps": 2, "one": 1}
    assert as_set(observed.filter("country = 'one'"), "exposure", "date") == {(2, D(2020, 3, 31))}
    dense = panel.forecast_grid(rows, "country", "date", "exposure", 21, ["region"], mode="dense")
    assert dense.count() == 63
    assert as_set(dense.filter("country = 'gaps' and exposure = 32"), "date", "region") == {(D(2020, 4, 1), "S")}


def test_recent_active_window(counts):
    from panelyard.operators.windows import deltas

    rows = deltas(counts, "country", "date", {"new": "confirmed"}, exposure="exposure")
    kept = panel.recent_active_window(rows, "country", "new", "exposure", 21, ["one"])
    assert kept.filter("country = 'long'").count() == 21 and kept.filter("country = 'one'").count() == 0


def test_scenario_costs_and_days(spark):
    areas = spark.createDataFrame([("P", 1000.0, 2, 1)], "area string, pop double, four int, eight int")
    staff = s.staff_by_type(
        spark.createDataFrame([("Nurse", "4", "9"), ("EMT", "On Call", "1"), ("Translator", "One per language", "2")],
                              ["Position", "a", "b"]),
        "Position", {"four": "a", "eight": "b"}, {("EMT", "four"): 1, ("Translator", "four"): 3},
    )
    people = s.headcount(areas, ["area"], {"four": "four", "eight": "eight"}, staff)
    assert as_set(people, "role", "people") == {("Nurse", 17.0), ("EMT", 3.0), ("Translator", 8.0)}
    wages = spark.createDataFrame([("Nurse", 20.0), ("EMT", 10.0), ("Translator", 15.0)], "role string, wage double")
    cost = s.personnel_cost(people, ["area"], wages)
    assert cost.first()["cost_personnel"] == (17 * 20 + 3 * 10 + 8 * 15) * 8
    rows = s.with_target(s.with_scenarios(areas, [s.Scenario("x", percent=80, doses_given=8800)]), "pop")
    full = s.with_days_to_goal(s.with_costs(s.with_capacity(rows, {"four": 1900, "eight": 5000}).join(cost, "area"))).first()
    assert full["target"] == 800_000 and full["capacity"] == 8800 and full["days_to_goal"] == 90.0
    assert full["cost_total"] == 10_000 + 1000 * 32 + full["cost_personnel"]
    assert as_set(s.staff_table(staff, "four"), "role", "workers") == {("Nurse", 4.0), ("EMT", 1.0), ("Translator", 3.0)}
