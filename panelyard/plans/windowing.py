"""Ordered panel operators on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.dates import days_since
from panelyard.functions.distributions import AS241
from panelyard.operators import scale, windows
from panelyard.operators.aggregate import totals_by
from panelyard.operators.joins import left_join
from panelyard.plans.registry import query
from panelyard.plans.tables import LEVELS, PANEL_SQL, order_panel, rounded, table, text_date


@query(
    "w1_daily_change",
    f"""WITH {PANEL_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, CAST(placed - lag(placed, 1, 0) OVER w AS BIGINT) AS new_placed,
        CAST(finished - lag(finished, 1, 0) OVER w AS BIGINT) AS new_finished
        FROM panel WINDOW w AS (PARTITION BY nation ORDER BY day)""",
)
def daily_change(spark, sf_dir):
    out = windows.deltas(
        order_panel(spark, sf_dir), "nation", "day", {"new_placed": "placed", "new_finished": "finished"}
    )
    return out.select("nation", text_date("day"), "new_placed", "new_finished")


@query(
    "w2_change_of_totals",
    f"""WITH {PANEL_SQL}, t AS (SELECT day, sum(placed) AS placed, sum(open) AS open FROM panel GROUP BY 1)
        SELECT CAST(day AS VARCHAR) AS day, CAST(placed - lag(placed, 1, 0) OVER (ORDER BY day) AS BIGINT) AS new_placed,
        CAST(open - lag(open, 1, 0) OVER (ORDER BY day) AS BIGINT) AS new_open FROM t""",
)
def change_of_totals(spark, sf_dir):
    totals = totals_by(order_panel(spark, sf_dir), "day", LEVELS)
    out = windows.series_deltas(totals, "day", {"new_placed": "placed", "new_open": "open"})
    return out.select(text_date("day"), "new_placed", "new_open")


@query(
    "w3_exposure",
    """SELECT event_id, user_id, CAST(CAST(ts AS DATE) - CAST(min(ts) OVER (PARTITION BY user_id) AS DATE) + 1 AS INTEGER) AS exposure
       FROM events""",
)
def exposure(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = windows.deltas(rows, "user_id", "ts", {"change": "value"}, exposure="exposure")
    return out.select("event_id", "user_id", "exposure")


@query(
    "w4_days_since_origin",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1998-03-31' AS INTEGER) AS days_since FROM orders",
)
def days_since_origin(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", days_since("o_orderdate", "1998-03-31").alias("days_since"))


@query(
    "w5_group_max_on_rows",
    f"""WITH {PANEL_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, CAST(max(day) OVER w AS VARCHAR) AS last_day,
        max(placed) OVER w AS last_placed FROM panel WINDOW w AS (PARTITION BY nation)""",
)
def group_max_on_rows(spark, sf_dir):
    out = windows.attach_group_max(order_panel(spark, sf_dir), "nation", {"last_day": "day", "last_placed": "placed"})
    return out.select("nation", text_date("day"), text_date("last_day"), "last_placed")


@query(
    "w6_recent_rows_with_ties",
    """SELECT c_nationkey, o_orderkey, day FROM (SELECT c_nationkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
         rank() OVER (PARTITION BY c_nationkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS r
       FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 21""",
)
def recent_rows_with_ties(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return windows.recent_n(rows, "c_nationkey", "day", 21).select("c_nationkey", "o_orderkey", text_date("day"))


@query(
    "w7_zscore",
    """SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS price_z,
              round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS size_z FROM part""",
)
def zscore(spark, sf_dir):
    out = scale.zscore(table(spark, sf_dir, "part"), {"price_z": "p_retailprice", "size_z": "p_size"})
    return out.select("p_partkey", rounded("price_z", 6), rounded("size_z", 6))


@query(
    "w8_centred",
    """SELECT p_partkey, round(p_retailprice * 0.01 - avg(p_retailprice * 0.01) OVER (), 6) AS price_c FROM part""",
)
def centred(spark, sf_dir):
    out = scale.centre(table(spark, sf_dir, "part"), {"price_c": ("p_retailprice", 0.01)})
    return out.select("p_partkey", rounded("price_c", 6))


@query(
    "w9_offset_from_base",
    """SELECT o_orderkey, CAST(year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) AS INTEGER) AS year_c FROM orders""",
)
def offset_from_base(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return scale.offset_from(rows, "year", "year_c").drop("year")


@query(
    "w10_holm",
    """WITH p AS (SELECT l_suppkey, round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) / 100, 6) AS p FROM lineitem GROUP BY 1),
       o AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS rn, count(*) OVER () AS n FROM p)
       SELECT l_suppkey, p, round(least(1, max((n - rn + 1) * p) OVER (ORDER BY p, l_suppkey ROWS UNBOUNDED PRECEDING)), 8) AS adjusted FROM o""",
)
def holm(spark, sf_dir):
    share = F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(F.lit(0.0))
    tests = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(share) / 100, 6).alias("p"))
    return windows.holm(tests, "p").withColumn("adjusted", F.round("adjusted", 8))


def _quantile_sql(p: str) -> str:
    """The normal quantile of a SQL expression, by the published rational approximations."""

    def ratio(r: str, over, under) -> str:
        def horner(terms) -> str:
            out = f"{terms[0]!r}::DOUBLE"
            for t in terms[1:]:
                out = f"({out} * ({r}) + {t!r}::DOUBLE)"
            return out

        return f"{horner(over)} / {horner(under)}"

    q, tail = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1.0::DOUBLE - {p})))"
    centre = f"{q} * {ratio(f'0.180625::DOUBLE - {q} * {q}', AS241[0], AS241[1])}"
    near, far = ratio(f"{tail} - 1.6::DOUBLE", AS241[2], AS241[3]), ratio(f"{tail} - 5.0::DOUBLE", AS241[4], AS241[5])
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * (CASE WHEN {tail} <= 5 THEN {near} ELSE {far} END) END"


@query(
    "w11_qq_points",
    f"""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
        q AS (SELECT *, CASE WHEN n <= 10 THEN (rn - 0.375::DOUBLE) / (n + 0.25::DOUBLE) ELSE (rn - 0.5::DOUBLE) / n END AS p FROM r)
        SELECT o_orderkey, o_totalprice, round(p, 9) AS p, round({_quantile_sql("p")}, 6) AS theoretical FROM q""",
)
def qq_points(spark, sf_dir):
    """One point for every order."""
    q = windows.qq_points(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])
    return q.select("o_orderkey", "o_totalprice", rounded("p", 9), rounded("theoretical", 6))


# In whole cents until the division, so both sides order the residuals alike.
_RESIDUALS = f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
    g AS (SELECT l_suppkey, CAST(sum(cents) AS BIGINT) AS s, count(*) AS n FROM c GROUP BY 1),
    r AS (SELECT l_orderkey, l_linenumber, CAST(cents * n - s AS DOUBLE) / n AS x FROM c JOIN g USING (l_suppkey)),
    k AS (SELECT *, row_number() OVER (ORDER BY x, l_orderkey, l_linenumber) AS rn, count(*) OVER () AS n FROM r),
    q AS (SELECT *, (rn - 0.5::DOUBLE) / n AS p FROM k)
    SELECT l_orderkey, l_linenumber, x AS residual, round({_quantile_sql("p")}, 6) AS theoretical FROM q"""


@query("w11_qq_residuals", _RESIDUALS)
def qq_residuals(spark, sf_dir):
    """Residuals of all lines about the mean of their supplier against the normal distribution."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", cents.alias("cents"))
    sums = lines.groupBy("l_suppkey").agg(F.sum("cents").alias("s"), F.count("cents").alias("n"))
    rows = left_join(lines, sums, "l_suppkey").select(
        "l_orderkey", "l_linenumber", ((F.col("cents") * F.col("n") - F.col("s")).cast("double") / F.col("n")).alias("residual")
    )
    q = windows.qq_points(rows, "residual", ["l_orderkey", "l_linenumber"])
    return q.select("l_orderkey", "l_linenumber", "residual", rounded("theoretical", 6))
