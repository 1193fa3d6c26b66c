"""Projections, filters and repairs on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.numeric import safe_log
from panelyard.functions.text import category_headers, coded_headers, contains_text, header_part
from panelyard.operators import clean, keys, reshape
from panelyard.plans.registry import query
from panelyard.plans.tables import YEARLY_SQL, YEARS, finite, table, yearly_orders


@query("p1_project_names", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def project_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("p2_project_positions", "SELECT p_partkey, p_brand, p_type, p_retailprice FROM part")
def project_positions(spark, sf_dir):
    return clean.drop_positions(clean.select_positions(table(spark, sf_dir, "part"), [0, range(2, 6)]), [3])


@query("p3_project_fragments", "SELECT s_name, s_suppkey, s_nationkey FROM supplier")
def project_fragments(spark, sf_dir):
    return clean.select_matching(table(spark, sf_dir, "supplier"), ["name", "key"])


@query("p4_drop_column", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def drop_column(spark, sf_dir):
    return table(spark, sf_dir, "supplier").drop("s_acctbal")


@query(
    "p5_rename_affixed",
    "SELECT p_partkey, p_size AS p_size_catalog, p_retailprice AS p_retailprice_catalog FROM part",
)
def rename_affixed(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return clean.rename_affixed(part, ["p_size", "p_retailprice"], suffix="catalog")


def yearly_sheet(spark, sf_dir):
    """One row per nation, two columns per year."""
    return reshape.to_wide(
        yearly_orders(spark, sf_dir), ["nation", "region"], "year", YEARS, ["orders", "value"], "{value}_{name}"
    )


_WIDE = ", ".join(
    f"coalesce(max(orders) FILTER (WHERE year = {y}), 0) AS \"Orders_{y}\", "
    f"round(coalesce(max(value) FILTER (WHERE year = {y}), 0), 2) AS \"Value_{y}\""
    for y in YEARS
)


@query("p6_coded_headers", f"WITH {YEARLY_SQL} SELECT nation AS \"Nation_\", {_WIDE} FROM yearly GROUP BY 1")
def coded_header_sheet(spark, sf_dir):
    sheet = yearly_sheet(spark, sf_dir).drop("region").na.fill(0)
    raw = ["Na.tion"] + [f"{m}...{i}" for i, m in enumerate(["Orders", "Value"] * len(YEARS))]
    return sheet.toDF(*coded_headers(raw, YEARS, each=2, plain=1))


_FLAGS = ["A", "N", "R"]
_CATEGORY = ", ".join(
    f"count(*) FILTER (WHERE l_returnflag = '{f}') AS \"{f}_Lines\", "
    f"round(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 0), 2) AS \"{f}_Quantity\""
    for f in _FLAGS
)


@query("p7_category_headers", f"SELECT l_linestatus AS \"Status\", {_CATEGORY} FROM lineitem GROUP BY 1")
def category_header_sheet(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        *[
            c
            for f in _FLAGS
            for c in (
                F.count_if(F.col("l_returnflag") == f),
                F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0)), 2),
            )
        ]
    )
    return wide.toDF(*category_headers(["Status 1"] + ["Lines (1)", "Quantity (2)"] * 3, _FLAGS, each=2))


_PERIODS = {"1995-1997": (1995, 1997), "1998-2001": (1998, 2001)}
_PERIOD_SQL = ", ".join(
    f"CAST(coalesce(sum(orders) FILTER (WHERE year BETWEEN {a} AND {b}), 0) AS BIGINT) AS \"{b}\""
    for a, b in _PERIODS.values()
)


@query("p8_header_end_year", f"WITH {YEARLY_SQL} SELECT nation, {_PERIOD_SQL} FROM yearly GROUP BY 1")
def header_end_year(spark, sf_dir):
    totals = yearly_orders(spark, sf_dir).groupBy("nation").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("year").between(a, b), F.col("orders"))), F.lit(0)).alias(name)
            for name, (a, b) in _PERIODS.items()
        ]
    )
    return totals.toDF(*[header_part(c) for c in totals.columns])


@query(
    "p9_derived_chain",
    """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
              round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross
       FROM lineitem GROUP BY 1""",
)
def derived_chain(spark, sf_dir):
    rows = clean.derive(
        table(spark, sf_dir, "lineitem"),
        {
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "gross": F.col("net") * (1 + F.col("l_tax")),
        },
    )
    return rows.groupBy("l_returnflag").agg(
        F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("gross"), 2).alias("gross")
    )


@query(
    "p10_filter_ranges",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'
         AND o_orderstatus <> 'P' AND o_totalprice > 200000""",
)
def filter_ranges(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .filter(
            (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
            & (F.col("o_orderdate") < F.lit("1996-07-01").cast("timestamp_ntz"))
            & (F.col("o_orderstatus") != "P")
            & (F.col("o_totalprice") > 200000)
        )
        .select("o_orderkey", "o_totalprice", "o_orderstatus")
    )


@query(
    "p11_filter_text",
    "SELECT p_brand, count(*) AS parts FROM part WHERE contains(p_name, 'ring') GROUP BY 1",
)
def filter_text(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .filter(contains_text("p_name", "ring"))
        .groupBy("p_brand")
        .agg(F.count(F.lit(1)).alias("parts"))
    )


def labelled_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


_LABELLED = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(
    "p12_filter_present",
    f"SELECT d.lang, count(*) AS docs, CAST(sum(l.quality) AS BIGINT) AS good {_LABELLED} WHERE l.quality IS NOT NULL GROUP BY 1",
)
def filter_present(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir).filter(F.col("quality").isNotNull())
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("quality").alias("good"))


@query(
    "p13_drop_incomplete",
    f"""SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic {_LABELLED}
        WHERE d.lang IS NOT NULL AND d.n_chars IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
)
def drop_incomplete(spark, sf_dir):
    return clean.drop_incomplete(labelled_documents(spark, sf_dir))


@query(
    "p14_nan_to_missing",
    """SELECT s_nationkey, count(*) AS suppliers, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS with_log,
              round(avg(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END), 6) AS mean_log
       FROM supplier GROUP BY 1""",
)
def nan_to_missing(spark, sf_dir):
    # The log of a negative balance is NaN; a zero balance would be -Infinity.
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", safe_log("s_acctbal").alias("log_balance"))
    rows = clean.nan_columns_to_null(rows).withColumn("log_balance", finite("log_balance"))
    return rows.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("suppliers"),
        F.count("log_balance").alias("with_log"),
        F.round(F.avg("log_balance"), 6).alias("mean_log"),
    )


@query(
    "p15_missing_to_zero",
    f"""SELECT d.lang, CASE WHEN l.doc_id IS NULL THEN '0' ELSE 'seen' END AS mark,
               CAST(sum(coalesce(l.quality, 0)) AS BIGINT) AS quality, CAST(sum(coalesce(l.toxic, 0)) AS BIGINT) AS toxic
        {_LABELLED} GROUP BY 1, 2""",
)
def missing_to_zero(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir).withColumn("mark", F.when(F.col("quality").isNotNull(), "seen"))
    filled = clean.missing_to_zero(rows, text=True)
    return filled.groupBy("lang", "mark").agg(F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))


@query(
    "p16_tolerant_number",
    """SELECT p_brand, count(TRY_CAST(CASE WHEN p_size > 25 THEN 'On Call' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE)) AS numeric_cells,
              sum(TRY_CAST(CASE WHEN p_size > 25 THEN 'On Call' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE)) AS total
       FROM part GROUP BY 1""",
)
def tolerant_number(spark, sf_dir):
    mixed = table(spark, sf_dir, "part").select(
        "p_brand", F.when(F.col("p_size") > 25, "On Call").otherwise(F.col("p_size").cast("string")).alias("cell")
    )
    return (
        clean.to_number(mixed, skip=["p_brand"])
        .groupBy("p_brand")
        .agg(F.count("cell").alias("numeric_cells"), F.sum("cell").alias("total"))
    )


@query("p17_to_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def to_text(spark, sf_dir):
    return clean.to_text(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_size"])


@query(
    "p18_threshold_flags",
    f"""SELECT d.lang, CASE WHEN l.quality IS NULL THEN -1 WHEN l.quality >= 1 THEN 1 ELSE 0 END AS good,
               CASE WHEN d.n_chars >= 2000 THEN 1 ELSE 0 END AS long, count(*) AS docs {_LABELLED} GROUP BY 1, 2, 3""",
)
def threshold_flags(spark, sf_dir):
    flags = clean.binarise(labelled_documents(spark, sf_dir), {"good": ("quality", 1), "long": ("n_chars", 2000)})
    return (
        flags.withColumn("good", F.coalesce("good", F.lit(-1)))
        .groupBy("lang", "good", "long")
        .agg(F.count(F.lit(1)).alias("docs"))
    )


# A chain: NATION_1 passes through NATION_2 on its way, and NATION_7 is renamed there and back.
RECODES = [
    ("NATION_1", "NATION_2"),
    ("NATION_2", "SECOND"),
    ("NATION_5", "FIFTH"),
    ("NATION_7", "SEVENTH"),
    ("SEVENTH", "NATION_7"),
    ("NATION_99", "NOWHERE"),
]


@query(
    "p19_recode_chain",
    """SELECT CASE n_name WHEN 'NATION_1' THEN 'SECOND' WHEN 'NATION_2' THEN 'SECOND' WHEN 'NATION_5' THEN 'FIFTH'
                   ELSE n_name END AS nation, count(*) AS customers
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def recode_chain(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation")
    named = keys.recode(
        counts.join(nation, counts.c_nationkey == nation.n_nationkey), "n_name", RECODES, into="nation"
    )
    return named.groupBy("nation").agg(F.sum("n").alias("customers"))


@query(
    "p19_recode_table",
    """SELECT coalesce(r_name, 'unknown') AS area, count(*) AS nations
       FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def recode_table(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("code", F.col("n_regionkey").cast("string"))
    region = table(spark, sf_dir, "region").withColumn("code_from", F.col("r_regionkey").cast("string"))
    named = keys.recode_from(nation, "code", region, "code_from", "r_name", into="area")
    return named.groupBy("area").agg(F.count(F.lit(1)).alias("nations"))


@query(
    "p20_rescale_one_group",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal * 1000, 2) ELSE round(c_acctbal, 2) END AS c_acctbal
       FROM customer""",
)
def rescale_one_group(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    scaled = clean.rescale(customers, "c_acctbal", 1000, where=F.col("c_mktsegment") == "BUILDING")
    return scaled.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query(
    "p21_patch_cells",
    """SELECT n_name, CASE WHEN n_name = 'NATION_3' THEN 9 ELSE n_regionkey END AS n_regionkey,
              CASE WHEN n_name = 'NATION_4' THEN -1 ELSE n_nationkey END AS n_nationkey FROM nation""",
)
def patch_cells(spark, sf_dir):
    return clean.patch_cells(
        table(spark, sf_dir, "nation"),
        "n_name",
        {("NATION_3", "n_regionkey"): 9, ("NATION_4", "n_nationkey"): -1},
    )


@query("p22_constant_column", "SELECT r_regionkey, r_name, r_name AS area, true AS replace FROM region")
def constant_column(spark, sf_dir):
    return table(spark, sf_dir, "region").withColumn("area", F.col("r_name")).withColumn("replace", F.lit(True))
