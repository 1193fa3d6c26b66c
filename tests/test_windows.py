import datetime as dt
import random
from statistics import NormalDist

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from panelyard.functions.distributions import normal_quantile_column
from panelyard.operators import windows as w

D = dt.date


@pytest.fixture()
def counts(spark):
    rows = [
        ("a", D(2020, 1, 1), 5, 0), ("a", D(2020, 1, 2), 5, 1), ("a", D(2020, 1, 5), 3, 1),
        ("b", D(2020, 1, 2), 7, None), ("b", D(2020, 1, 3), 9, 2),
        (None, D(2020, 1, 1), 1, 1), (None, D(2020, 1, 9), 4, 2),
        ("c", None, 100, 1),
    ]
    return spark.createDataFrame(rows, "e string, t date, x bigint, y bigint")


EXPECTED = {
    ("a", D(2020, 1, 1), 5, 0, 1), ("a", D(2020, 1, 2), 0, 1, 2), ("a", D(2020, 1, 5), -2, 0, 5),
    ("b", D(2020, 1, 2), 7, None, 1), ("b", D(2020, 1, 3), 2, None, 2),
    (None, D(2020, 1, 1), 1, 1, 1), (None, D(2020, 1, 9), 3, 1, 9),
}


@pytest.mark.parametrize("scan", [False, True])
def test_deltas_keep_first_level_and_missing(counts, scan):
    out = w.deltas(counts, "e", "t", {"dx": "x", "dy": "y"}, exposure="exposure", scan=scan)
    assert as_set(out, "e", "t", "dx", "dy", "exposure") == EXPECTED


@pytest.mark.parametrize("kind", ["date", "timestamp", "double", "bigint"])
def test_repeated_key_stops_the_job(spark, kind):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 1), ("a", D(2020, 1, 1), 2)], "e string, t date, x bigint")
    if kind != "date":
        seconds = F.unix_seconds(F.col("t").cast("timestamp"))
        df = df.withColumn("t", F.col("t").cast("timestamp") if kind == "timestamp" else seconds.cast(kind))
    with pytest.raises(Exception, match="panel key repeats"):
        w.deltas(df, "e", "t", {"dx": "x"}).collect()


@pytest.mark.parametrize("kind", ["date", "bigint", "timestamp"])
def test_running_total_inverts_deltas_with_a_hot_entity(spark, kind):
    rng = random.Random(3)
    rows = [("hot", i, rng.randint(-5, 9)) for i in range(3000)] + [(f"e{i % 40}", i, i % 7) for i in range(900)]
    time = {
        "date": F.date_add(F.lit("1990-01-01").cast("date"), F.col("i").cast("int")),
        "bigint": F.col("i") * 3,
        "timestamp": F.timestamp_seconds(F.col("i") * 900),
    }[kind]
    df = spark.createDataFrame(rows, "e string, i bigint, d bigint").withColumn("t", time)
    scan = kind == "date"
    assert as_set(w.hot_entities(df, ["e"], 1000), "_h0", "_n") == {("hot", 3000)}
    levels = w.running_totals(df, "e", "t", {"level": "d"}, scan)
    back = w.deltas(levels, "e", "t", {"again": "level"}, scan=scan)
    assert back.count() == len(rows)
    assert back.filter("again <> d").count() == 0
    top = levels.groupBy("e").agg(F.max_by("level", "t").alias("last"))
    sums = df.groupBy("e").agg(F.sum("d").alias("s"))
    assert top.join(sums, "e").filter("last <> s").count() == 0


def test_series_deltas(spark):
    df = spark.createDataFrame([(D(2020, 1, i), i * i) for i in range(1, 9)], "t date, x bigint")
    for scan in (False, True):
        out = w.series_deltas(df, "t", {"d": "x"}, scan)
        assert as_set(out, "t", "d") == {(D(2020, 1, i), 2 * i - 1) for i in range(1, 9)}


def test_recent_n_keeps_ties(spark):
    rows = [("a", v, k) for k, v in enumerate([9, 9, 8, 8, 8, 7, 1])] + [("b", 1, 7)] + [("c", None, 8), ("c", 5, 9)]
    df = spark.createDataFrame(rows, "e string, v int, k int")
    kept = as_set(w.recent_n(df, "e", "v", 3), "k")
    assert kept == {(0,), (1,), (2,), (3,), (4,), (7,), (9,)}
    assert as_set(w.recent_n(df, "e", "v", 2), "k") == {(0,), (1,), (7,), (9,)}
    for n in (1, 3, 5):
        assert as_set(w.recent_n(df, "e", "v", n, unique=True), "k") == as_set(w.recent_n(df, "e", "v", n), "k")


def test_recent_n_against_rank_on_random_ties(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"e{rng.randint(0, 9)}", rng.randint(0, 60), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "e string, v int, k int")
    got = as_set(w.recent_n(df, "e", "v", 21), "k")
    expected = set()
    for e in {r[0] for r in rows}:
        values = sorted((r[1] for r in rows if r[0] == e), reverse=True)
        limit = values[min(20, len(values) - 1)]
        expected |= {(r[2],) for r in rows if r[0] == e and r[1] >= limit}
    assert got == expected


def holm_brute(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, top = [0.0] * len(ps), 0.0
    for rank, i in enumerate(order):
        top = max(top, (len(ps) - rank) * ps[i])
        out[i] = min(1.0, top)
    return out


def test_holm_with_heavy_ties_and_tiny_values(spark):
    rng = random.Random(5)
    ps = [1.0] * 300 + [0.0] * 20 + [rng.random() for _ in range(300)] + [10 ** -rng.uniform(1, 300) for _ in range(300)]
    ps += [5e-324, 2.0**-8, 2.0**-8 - 1e-12]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(len(ps), None)], "i int, p double")
    got = {r["i"]: r["adjusted"] for r in w.holm(df, "p").collect()}
    for i, expected in enumerate(holm_brute(ps)):
        assert got[i] == pytest.approx(expected, rel=1e-12, abs=1e-300)
    assert got[len(ps)] is None


@pytest.mark.parametrize("shift", [0, 10**6])
def test_one_entity_between_zero_and_one_is_cut(spark, shift):
    """All times of the large entity are close together, far from those of another one."""
    rng = random.Random(9)
    times = rng.sample(range(100_000), 4000)
    rows = [("big", shift + t / 100_000, rng.randint(0, 9)) for t in times] + [("far", 1e9 + i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "e string, t double, x bigint").repartition(3)
    sizes = w.range_cells(df, ["e", "t"]).groupBy("_cell").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 0.5 * len(rows)
    out = w.with_previous(df, "e", "t", ["x"])
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["e"], r["t"], r["x"], r["_previous"]["x"] if r["_previous"] else None, r["_start"]) for r in out.collect())
    rows.sort()
    before = {r[:2]: p[2] for p, r in zip(rows, rows[1:]) if p[0] == r[0]}
    first = {e: min(r[1] for r in rows if r[0] == e) for e in ("big", "far")}
    assert got == [(e, t, x, before.get((e, t)), first[e]) for e, t, x in rows]


def test_ranks_of_ties_missing_and_repeated_values(spark):
    rng = random.Random(2)
    values = [5.0] * 900 + [rng.randint(0, 40) / 4 for _ in range(600)] + [float("nan"), None, float("inf"), -0.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, x double").repartition(5)
    got = w.ranked(df, "x").collect()
    kept = sorted(v for v in values if v is not None and v == v)
    assert sorted(r["rank"] for r in got) == list(range(1, len(kept) + 1))
    assert all(kept[r["rank"] - 1] == r["x"] and r["total"] == len(kept) for r in got)
    tied = {r["k"]: r["rank"] for r in w.ranked(df, "x", ["k"]).collect()}
    order = sorted((v, k) for k, v in enumerate(values) if v is not None and v == v)
    assert tied == {k: i for i, (_, k) in enumerate(order, 1)}
    assert w.ranked(df.filter("false"), "x").count() == 0


@pytest.mark.parametrize("n", [1, 7, 10, 11, 3000])
def test_qq_points(spark, n):
    df = spark.createDataFrame([(float(i * i), i) for i in range(n)], "x double, k int")
    rows = w.qq_points(df, "x").orderBy("k").collect()
    a = 3 / 8 if n <= 10 else 1 / 2
    assert [r["p"] for r in rows] == pytest.approx([(i - a) / (n + 1 - 2 * a) for i in range(1, n + 1)], rel=1e-12)
    quantile = NormalDist().inv_cdf
    assert [r["theoretical"] for r in rows] == pytest.approx([quantile(r["p"]) for r in rows], rel=1e-12, abs=1e-15)


def test_normal_quantile_in_the_far_tails(spark):
    ps = [1e-300, 1e-40, 1e-12, 1e-5, 0.07, 0.075, 0.0751, 0.5, 0.925, 0.99999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(normal_quantile_column(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-13, abs=1e-15)


def test_latest_and_group_max(counts):
    assert as_set(w.latest_rows(counts, "t"), "e", "x") == {(None, 4)}
    top = w.attach_group_max(counts, "e", {"top": "x"})
    assert ("a", 3, 5) in as_set(top, "e", "x", "top") and (None, 1, 4) in as_set(top, "e", "x", "top")
