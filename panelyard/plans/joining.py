"""Joins and key reports on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.models.ols import linear_regression
from panelyard.operators import joins, keys, windows
from panelyard.plans.registry import query
from panelyard.plans.tables import (
    PANEL_SQL,
    order_panel,
    rounded,
    table,
    text_date,
    user_days,
    user_days_sql,
)
from panelyard.sources.geo import explode_features


@query(
    "j1_left_same_key",
    """SELECT d.doc_id, d.lang, CAST(l.quality AS DOUBLE) AS quality
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def left_same_key(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return joins.left_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "doc_id")


@query(
    "j2_left_other_key",
    """SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def left_other_key(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return joins.left_join(suppliers, table(spark, sf_dir, "nation"), {"s_nationkey": "n_nationkey"})


@query(
    "j3_left_composite",
    f"""WITH {user_days_sql('click', 'click')}, {user_days_sql('purchase', 'buy')}
        SELECT c.user_id, CAST(c.day AS VARCHAR) AS day, c.clicks, CAST(b.buys AS DOUBLE) AS buys
        FROM click_days c LEFT JOIN buy_days b ON c.user_id = b.user_id AND c.day = b.day""",
)
def left_composite(spark, sf_dir):
    clicks = user_days(spark, sf_dir, "click", "click")
    buys = user_days(spark, sf_dir, "purchase", "buy")
    joined = joins.left_join(clicks, buys, ["user_id", "day"])
    return joined.select("user_id", text_date("day"), "clicks", F.col("buys").cast("double").alias("buys"))


@query(
    "j4_full_outer",
    f"""WITH {user_days_sql('click', 'click')}, {user_days_sql('purchase', 'buy')}
        SELECT coalesce(c.user_id, b.user_id) AS user_id, CAST(coalesce(c.day, b.day) AS VARCHAR) AS day,
               CAST(c.clicks AS DOUBLE) AS clicks, CAST(b.buys AS DOUBLE) AS buys
        FROM click_days c FULL OUTER JOIN buy_days b ON c.user_id = b.user_id AND c.day = b.day""",
)
def full_outer(spark, sf_dir):
    clicks = user_days(spark, sf_dir, "click", "click")
    buys = user_days(spark, sf_dir, "purchase", "buy")
    joined = joins.full_join(clicks, buys, ["user_id", "day"])
    return joined.select(
        "user_id", text_date("day"), F.col("clicks").cast("double").alias("clicks"), F.col("buys").cast("double").alias("buys")
    )


@query(
    "j5_semi_join",
    """SELECT c_mktsegment, count(*) AS customers FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""",
)
def semi_join(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select("o_custkey")
    kept = keys.keep_entities(table(spark, sf_dir, "customer"), "c_custkey", pending)
    return kept.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "j6_anti_join",
    """SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def anti_join(spark, sf_dir):
    return keys.unmatched_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "j7_join_twice",
    """SELECT o.o_orderkey, a.c_acctbal AS c_acctbal_x, a.c_mktsegment AS c_mktsegment_x,
              b.c_acctbal AS c_acctbal_y, b.c_mktsegment AS c_mktsegment_y
       FROM orders o LEFT JOIN customer a ON o.o_custkey = a.c_custkey LEFT JOIN customer b ON o.o_custkey = b.c_custkey""",
)
def join_twice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    once = joins.left_join(orders, customers, {"o_custkey": "c_custkey"})
    return joins.left_join(once, customers, {"o_custkey": "c_custkey"}).drop("o_custkey")


@query(
    "j8_rows_at_last_date",
    f"""WITH {PANEL_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed, finished, open
        FROM panel WHERE day = (SELECT max(day) FROM panel)""",
)
def rows_at_last_date(spark, sf_dir):
    latest = windows.latest_rows(order_panel(spark, sf_dir), "day")
    return latest.select("nation", text_date("day"), "placed", "finished", "open")


@query(
    "j9_scores_on_rows",
    """WITH fit AS (SELECT regr_slope(o_totalprice, c_acctbal) AS b, regr_intercept(o_totalprice, c_acctbal) AS a
                    FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT o_orderkey, round(a + b * c_acctbal, 3) AS fitted FROM orders JOIN customer ON o_custkey = c_custkey, fit""",
)
def scores_on_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    fit = linear_regression(rows, "o_totalprice ~ c_acctbal")
    return fit.score(rows).select("o_orderkey", rounded("fitted", 3))


@query(
    "j10_geo_join",
    """WITH places AS (SELECT n_name AS place, count(*) AS population FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
       SELECT n_name AS name, 'Point' AS geometry_type, '[' || n_nationkey || ',0]' AS coordinates,
         '{"name":"' || n_name || '"}' AS properties, CAST(population AS DOUBLE) AS value, 'population' AS metric
       FROM nation LEFT JOIN places ON n_name = place""",
)
def geo_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    # One feature collection per nation, in the shape a geo file has after parsing.
    feature = F.struct(
        F.to_json(F.struct(F.col("n_name").alias("name"))).alias("properties"),
        F.struct(
            F.lit("Point").alias("type"), F.format_string("[%d,0]", F.col("n_nationkey")).alias("coordinates")
        ).alias("geometry"),
    )
    features = explode_features(nation.select(F.array(feature).alias("features")))
    # A small table lacks suppliers in some nations; their features keep an empty value.
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("population"))
    metrics = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("place"), "population")
    out = joins.geo_join(features, metrics, "name", "place", "population")
    return out.withColumn("value", F.col("value").cast("double"))


@query(
    "u1_union_all",
    """SELECT 'customer' AS kind, c_nationkey AS nationkey, round(c_acctbal, 2) AS balance FROM customer
       UNION ALL SELECT 'supplier', s_nationkey, round(s_acctbal, 2) FROM supplier""",
)
def union_all(spark, sf_dir):
    def side(name, letter):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("kind"),
            F.col(f"{letter}_nationkey").alias("nationkey"),
            F.round(f"{letter}_acctbal", 2).alias("balance"),
        )

    return side("customer", "c").unionByName(side("supplier", "s"))


@query("u2_key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, sf_dir):
    return keys.unmatched_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("u3_key_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def key_intersection(spark, sf_dir):
    return keys.shared_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "c10_key_coverage",
    """WITH l AS (SELECT doc_id AS key, count(*) AS n FROM documents GROUP BY 1),
            r AS (SELECT doc_id AS key, count(*) AS n FROM labels GROUP BY 1)
       SELECT coalesce(l.key, r.key) AS key, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows,
              CASE WHEN r.n IS NULL THEN 'left_only' WHEN l.n IS NULL THEN 'right_only' ELSE 'both' END AS status
       FROM l FULL OUTER JOIN r ON l.key = r.key""",
)
def key_coverage(spark, sf_dir):
    return keys.key_coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id").select(
        "key", F.col("left_rows").cast("bigint").alias("left_rows"), F.col("right_rows").cast("bigint").alias("right_rows"), "status"
    )
