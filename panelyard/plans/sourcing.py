"""Readers and writers exercised on files that Spark derives from the benchmark tables.

Files go to a new folder below the shared checkpoint folder and are read back with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import clean, keys, reshape
from panelyard.plans.registry import query
from panelyard.plans.tables import (
    PANEL_SQL,
    SHEET_SQL,
    YEARS,
    order_panel,
    rounded,
    table,
    text_date,
    yearly_orders,
)
from panelyard.session import shared_path
from panelyard.sources import csv, lookups, sinks
from panelyard.sources.geo import read_features
from panelyard.streaming.ingest import read_latest, start_ingest, stream_snapshots

MONTHLY_SQL = """
monthly AS (
  SELECT n_name AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, count(*) AS placed,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def monthly_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.trunc("o_orderdate", "month").alias("day"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    sums = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy("c_nationkey", "day")
        .agg(F.count(F.lit(1)).alias("placed"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    )
    return sums.join(nation, sums.c_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("nation"), "day", "placed", "finished"
    )


def write_monthly(spark, sf_dir, rows, header):
    """One folder of CSV per month, its date in the folder name, columns named as in ``header``."""
    path = shared_path(spark, "snapshots")
    out = rows.select(
        F.col("nation").alias(header), "placed", "finished", F.lit("not used").alias("Last Update"),
        F.date_format("day", "MM-dd-yyyy").alias("snapshot"),
    )
    # One writer per month at most: few files, and no month depends on another.
    sinks.write_snapshots(out.repartition("snapshot"), path, "snapshot")
    return path


@query("s1_dated_snapshots", f"WITH {MONTHLY_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed, finished FROM monthly")
def dated_snapshots(spark, sf_dir):
    path = write_monthly(spark, sf_dir, monthly_orders(spark, sf_dir), "Country_Region")
    rows = csv.read_snapshots(
        spark, path, {"Country_Region": "string", "placed": "bigint", "finished": "bigint"},
        renames={"Country_Region": "nation"}, date="day",
    )
    return rows.select("nation", text_date("day"), "placed", "finished")


@query("s2_two_eras", f"WITH {MONTHLY_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed FROM monthly")
def two_eras(spark, sf_dir):
    monthly, cut = monthly_orders(spark, sf_dir), F.lit("1998-01-01").cast("date")
    eras = []
    for header, rows in (
        ("Country/Region", monthly.filter(F.col("day") < cut)),
        ("Country_Region", monthly.filter(F.col("day") >= cut)),
    ):
        path = write_monthly(spark, sf_dir, rows, header)
        eras.append(
            csv.read_snapshots(spark, path, {header: "string", "placed": "bigint"}, {header: "nation"}, date="day")
        )
    return csv.stack_eras(eras).select("nation", text_date("day"), "placed")


@query(
    "s3_paths_of_a_date_range",
    """SELECT 'base/' || strftime(d, '%m-%d-%Y') || '.csv' AS path FROM (
         SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)""",
)
def paths_of_a_date_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    spine = csv.date_spine(orders, "day")
    return spine.select(F.concat(F.lit("base/"), F.date_format("date", "MM-dd-yyyy"), F.lit(".csv")).alias("path"))


@query("s4_flat_csv", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def flat_csv(spark, sf_dir):
    path = sinks.write_table(table(spark, sf_dir, "customer"), shared_path(spark, "flat"), file_format="csv")
    return csv.read_flat(spark, path, {"c_custkey": "bigint", "c_mktsegment": "string", "c_acctbal": "double"})


@query("s5_drop_row_index", "SELECT p_partkey, p_brand, p_size FROM part")
def drop_row_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    indexed = part.select(F.monotonically_increasing_id().alias("_c0"), "*")
    path = sinks.write_table(indexed, shared_path(spark, "indexed"), file_format="csv")
    read = csv.read_flat(spark, path, row_index=True)
    return read.select(F.col("p_partkey").cast("bigint"), "p_brand", F.col("p_size").cast("int"))


def write_sheet(spark, sheet, preamble, label):
    """A sheet of one row per nation below preamble lines, in one file as sheets are."""
    path = shared_path(spark, label)
    lines = [*preamble, ",".join(sheet.columns)]
    top = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "place int, value string")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("#N/A")) for c in sheet.columns]
    body = sheet.select(F.lit(len(lines)).alias("place"), F.concat_ws(",", *cells).alias("value"))
    top.union(body).coalesce(1).sortWithinPartitions("place").select("value").write.text(path)
    return path


def coverage_sheet(spark, sf_dir):
    # A third of the counts is not reported, as in the sheets.
    partial = yearly_orders(spark, sf_dir).withColumn("orders", F.when(F.col("orders") % 3 != 0, F.col("orders")))
    wide = reshape.to_wide(partial, ["nation"], "year", YEARS, ["orders"], "{name}")
    return wide.withColumnRenamed("nation", "Country")


_SHEET = f'WITH {SHEET_SQL} SELECT nation AS "Country", year AS "Year", orders AS pct FROM sheet'


def sheet_to_long(sheet):
    years = [c for c in sheet.columns if c != "Country"]
    long = reshape.to_long(sheet, ["Country"], years, "Year", "pct", cast="bigint")
    return long.withColumn("Year", F.col("Year").cast("int"))


@query("s6_below_preamble", _SHEET)
def below_preamble(spark, sf_dir):
    title = "," + ",".join(["Coverage estimates (%)"] * len(YEARS))
    path = write_sheet(spark, coverage_sheet(spark, sf_dir), [title], "preamble")
    return sheet_to_long(csv.read_sheet(spark, path, skip=1))


@query("s7_sheet_with_missing_token", _SHEET)
def sheet_with_missing_token(spark, sf_dir):
    notes = [f"note line {i}" for i in range(14)]
    path = write_sheet(spark, coverage_sheet(spark, sf_dir), notes, "sheet")
    return sheet_to_long(csv.read_sheet(spark, path, skip=14, null_value="#N/A"))


@query(
    "s8_landed_feed",
    """SELECT event_type AS location, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(sum(value), 2) AS total
       FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 0""",
)
def landed_feed(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("location"), F.to_date("ts").alias("date")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, F.round(F.sum("value"), 2)).alias("total"), F.max("props").alias("other")
    )
    path = sinks.write_table(sums, shared_path(spark, "feed"), file_format="csv")
    feed = clean.drop_incomplete(csv.read_flat(spark, path, {"location": "string", "date": "date", "total": "double"}))
    return feed.select("location", text_date("date"), "total")


@query(
    "s9_geo_features",
    """SELECT n_name AS name, 'Polygon' AS geometry_type,
         format('[[[{0},0],[{1},0],[{1},1],[{0},0]]]', n_nationkey, n_nationkey + 1) AS coordinates,
         '{"name":"' || n_name || '","id":' || n_nationkey || '}' AS properties FROM nation""",
)
def geo_features(spark, sf_dir):
    west = F.col("n_nationkey").cast("long")
    corners = [(west, 0), (west + 1, 0), (west + 1, 1), (west, 0)]
    ring = F.array(*[F.array(x, F.lit(y).cast("long")) for x, y in corners])
    feature = F.struct(
        F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    documents = table(spark, sf_dir, "nation").select(
        F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")
    )
    path = sinks.write_table(documents, shared_path(spark, "geo"), file_format="json")
    return read_features(spark, path, multi_line=False)


# A program-held table: region groups, keyed by group.
AREA_GROUPS = {"Old World": ["AFRICA", "ASIA", "EUROPE", "MIDDLE EAST"], "New World": ["AMERICA"]}


@query(
    "s10_inline_lookup",
    """SELECT CASE WHEN r_name = 'AMERICA' THEN 'New World' ELSE 'Old World' END AS area, count(*) AS customers
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def inline_lookup(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = counts.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    area = lookups.lookup_column("r_name", lookups.invert_groups(AREA_GROUPS))
    return rows.withColumn("area", area).groupBy("area").agg(F.sum("n").alias("customers"))


ALLOWED = ["NATION_1", "NATION_4", "NATION_9", "NATION_16", "ATLANTIS"]


@query(
    "s11_allow_list",
    f"""SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE n_name IN ({', '.join(repr(n) for n in ALLOWED)}) GROUP BY 1""",
)
def allow_list(spark, sf_dir):
    nation = keys.keep_entities(table(spark, sf_dir, "nation"), "n_name", ALLOWED)
    suppliers = table(spark, sf_dir, "supplier")
    rows = suppliers.join(nation, suppliers.s_nationkey == nation.n_nationkey)
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("s12_stage_table", f"WITH {PANEL_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed FROM panel WHERE year(day) = 1999")
def stage_table(spark, sf_dir):
    panel = order_panel(spark, sf_dir).withColumn("year", F.year("day"))
    path = sinks.write_table(panel, shared_path(spark, "stage"), partition_by=["year"])
    return spark.read.parquet(path).filter("year = 1999").select("nation", text_date("day"), "placed")


@query("s13_user_exports", f"WITH {MONTHLY_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed, placed - finished AS active FROM monthly")
def user_exports(spark, sf_dir):
    rows = monthly_orders(spark, sf_dir).withColumn("active", F.col("placed") - F.col("finished"))
    path = shared_path(spark, "export")
    sinks.export_table(rows, f"{path}/all", ["nation", "day", "placed"])
    sinks.export_by_entity(rows.select("nation", "day", "active"), f"{path}/by_nation", "nation")
    whole = csv.read_flat(spark, f"{path}/all", {"nation": "string", "day": "date", "placed": "bigint"})
    single = (
        spark.read.option("header", True).csv(f"{path}/by_nation")
        .select("nation", F.col("day").cast("date").alias("day"), F.col("active").cast("bigint").alias("active"))
    )
    return whole.join(single, ["nation", "day"]).select("nation", text_date("day"), "placed", "active")


@query(
    "s1_stream_incremental",
    f"""WITH {MONTHLY_SQL} SELECT nation, CAST(day AS VARCHAR) AS day, placed,
        CASE WHEN year(day) = 2000 THEN finished + 1000 ELSE finished END AS finished FROM monthly""",
)
def stream_incremental(spark, sf_dir):
    """Ingest all snapshots, then corrected ones for the year 2000, and read the current panel."""
    monthly = monthly_orders(spark, sf_dir)
    path, log = shared_path(spark, "landing"), shared_path(spark, "log")
    fixed = monthly.filter(F.year("day") == 2000).withColumn("finished", F.col("finished") + 1000)
    for part in (monthly, fixed):
        out = part.select("nation", "placed", "finished", F.date_format("day", "MM-dd-yyyy").alias("snapshot"))
        sinks.write_table(out.repartition("snapshot"), path, ["snapshot"], "csv", mode="append")
        stream = stream_snapshots(spark, path, "nation string, placed bigint, finished bigint", date="day")
        start_ingest(stream, f"{log}/table", f"{log}/checkpoint").awaitTermination()
    latest = read_latest(spark, f"{log}/table", ["nation", "day"], ["placed", "finished"])
    return latest.select("nation", text_date("day"), "placed", "finished")


