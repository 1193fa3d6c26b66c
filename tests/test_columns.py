import math

import numpy as np
import pytest
from conftest import as_set
from pyspark.sql import functions as F

from panelyard.functions import categories, dates, distributions, numeric, text
from panelyard.operators import aggregate, clean, keys, scale


def test_safe_log_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (math.e,), (None,)], "x double")
    got = [r[0] for r in df.select(numeric.safe_log("x")).collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == pytest.approx(1) and got[3] is None


def test_ratio_and_rates(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (5, None), (5, 2)], "x int, pop int")
    got = [tuple(r) for r in df.select(numeric.ratio("x", "pop"), numeric.per_population("x", "pop", pop_unit=1000)).collect()]
    assert got == [(None, None), (None, None), (None, None), (2.5, 250.0)]


def test_threshold_flag_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "x int")
    assert [r[0] for r in df.select(numeric.threshold_flag("x", 2)).collect()] == [None, 0, 1, 1]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(numeric.round_half_even("x")).collect()] == [0.0, 2.0, 2.0]


def test_dates(spark):
    df = spark.createDataFrame([("01-22-2020", "2020-01-22", 20200122), ("?", "", None)], "a string, b string, c int")
    out = df.select(
        dates.parse_mdy("a").alias("a"), dates.parse_ymd("b").alias("b"), dates.parse_compact("c").alias("c")
    )
    first, second = out.collect()
    assert first["a"] == first["b"] == first["c"] and str(first["a"]) == "2020-01-22"
    assert tuple(second) == (None, None, None)
    assert out.select(dates.days_since("a", "2020-03-31")).first()[0] == -69


def test_headers():
    names = ["Country/Territory", "Code", "Estimate...3", "StdErr...4", "Estimate...5", "StdErr...6"]
    assert text.coded_headers(names, [1996, 1998], 2) == [
        "CountryTerritory_", "Code_", "Estimate_1996", "StdErr_1996", "Estimate_1998", "StdErr_1998",
    ]
    assert text.category_headers(["Rank 1", "Score..2", "Rank.3"], ["Cat"], 2) == ["Rank", "Cat_Score", "Cat_Rank"]
    assert text.header_part("1950-1955") == "1955"


def test_categories(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "x string")
    assert [r[0] for r in df.select(categories.category_order("x", ["a", "b"])).collect()] == [1, None, None]
    assert as_set(categories.dummy_columns(df, "x", ["a", "b"]), "x", "x_b") == {("b", 1), ("z", None), (None, None)}


def test_student_t_known_values():
    # Two-sided probabilities from published t tables.
    for t, df, p in [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.960, 1e7, 0.05), (2.042, 30, 0.05)]:
        assert distributions.t_two_sided(t, df) == pytest.approx(p, rel=2e-3)
    assert distributions.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert np.isnan(distributions.t_two_sided(1.0, 0))
    assert distributions.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert distributions.t_two_sided(50.0, 200) == pytest.approx(distributions.t_two_sided(-50.0, 200))


def test_clean(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "7", None), ("b", float("nan"), "On Call", 2)], "name string, x double, cell string, n int"
    )
    assert clean.select_positions(df, [3, slice(0, 2)]).columns == ["n", "name", "x"]
    assert clean.drop_row_index(df).columns == ["x", "cell", "n"]
    assert clean.select_matching(df, ["n"], "starts_with").columns == ["name", "n"]
    assert clean.rename_affixed(df, ["x"], prefix="p", suffix="s").columns[1] == "p_x_s"
    assert as_set(clean.to_number(df, ["cell"]), "cell") == {(7.0,), (None,)}
    assert clean.drop_incomplete(df).count() == 0 and clean.drop_incomplete(df, ["x"]).count() == 1
    assert as_set(clean.nan_columns_to_null(df), "x") == {(1.0,), (None,)}
    assert as_set(clean.missing_to_zero(df), "x", "n") == {(1.0, 0), (0.0, 2)}
    assert as_set(clean.patch_cells(df, "name", {("a", "n"): 5, ("b", "cell"): "9"}), "n", "cell") == {(5, "7"), (2, "9")}
    assert as_set(clean.rescale(df, "n", 10, F.col("name") == "b"), "n") == {(None,), (20.0,)}


def test_recode_follows_rule_order(spark):
    rules = [("b", "c"), ("a", "b"), ("x", "y"), ("y", "z"), ("t", "u"), ("u", "t")]
    assert keys.compose_rules(rules) == {"b": "c", "a": "b", "x": "z", "y": "z", "t": "t", "u": "t"}
    df = spark.createDataFrame([("Côte d'Ivoire",), ("x",), ("other",), (None,)], "k string")
    out = keys.recode(df, "k", [*rules, ("Côte d'Ivoire", "Ivory Coast"), ("absent", "never")])
    assert as_set(out, "k") == {("Ivory Coast",), ("z",), ("other",), (None,)}


def test_key_reports(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    right = spark.createDataFrame([("b",), ("c",)], "q string")
    assert as_set(keys.key_coverage(left, right, "k", "q"), "key", "left_rows", "right_rows", "status") == {
        ("a", 2, 0, "left_only"), ("b", 1, 1, "both"), ("c", 0, 1, "right_only"),
    }
    assert as_set(keys.unmatched_keys(left, right, "k", "q"), "k") == {("a",)}
    assert as_set(keys.shared_keys(left, right, "k", "q"), "k") == {("b",)}
    assert keys.keep_entities(left, "k", right).count() == 1
    assert as_set(keys.check_unique_key(left, ["k"]), "k", "n_rows") == {("a", 2)}


def test_group_means_ignore_nan_and_null(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0), ("b", None)], "k string, x double"
    )
    assert as_set(aggregate.group_means(df, ["k"], ["x"]), "k", "x", "nrows") == {("a", 2.0, 4), ("b", None, 1)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(11)] + [(float("nan"), 0), (None, 1)], "x double, f int")
    rows = aggregate.histogram(df, "x", 5).orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["n"]) for r in rows] == [(0, 2, 2), (2, 4, 2), (4, 6, 2), (6, 8, 2), (8, 10, 3)]
    assert aggregate.histogram(df, "x", 5, ["f"], own_range=True).agg(F.sum("n")).first()[0] == 11
    flat = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert as_set(aggregate.histogram(flat, "x", 5), "bin", "n") == {(1, 2)}


def test_kpi_totals(spark):
    df = spark.createDataFrame([("2020-01-01", 1), ("2020-01-03", 4), ("2020-01-03", 5)], "t string, x int")
    df = df.withColumn("t", F.col("t").cast("date"))
    assert [str(v) for v in aggregate.kpi_totals(df, "t", ["x"]).first()] == ["9", "2020-01-03", "2"]
    at = aggregate.kpi_totals(df, "t", ["x"], F.lit("2020-01-01").cast("date")).first()
    assert [str(v) for v in at] == ["1", "2020-01-01", "2"]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2001), (3.0, 5.0, 2003), (None, 5.0, 2002)], "x double, c double, y int")
    out = scale.zscore(df, {"z": "x", "zc": "c"}).orderBy("y").collect()
    assert out[0]["z"] == pytest.approx(-1 / math.sqrt(2)) and out[0]["zc"] is None and out[1]["z"] is None
    assert as_set(scale.centre(df, {"k": ("x", 10)}), "k") == {(-10.0,), (10.0,), (None,)}
    assert as_set(scale.offset_from(df, "y", "o"), "o") == {(0,), (2,), (1,)}
    assert as_set(scale.offset_from(df, "y", "o", 2000), "o") == {(1,), (3,), (2,)}


def test_histogram_has_its_empty_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 1.0)], "f string, x double")
    assert [r.n for r in aggregate.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    faceted = aggregate.histogram(df, "x", 5, ["f"]).orderBy("f", "bin").collect()
    assert [r.n for r in faceted] == [1, 0, 0, 0, 1, 1, 0, 0, 0, 0]
