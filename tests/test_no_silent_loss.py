"""Inputs on which values used to vanish or move without a word."""

import os

import pytest
from pyspark.errors import PySparkException

from panelyard.operators import joins, keys, reshape
from panelyard.sources import csv
from panelyard.streaming import ingest


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_sheet_keeps_rows_that_look_like_its_preamble(spark, tmp_path):
    put(tmp_path, "sheet.csv", ",,,,,\nTitle,,,,,\na,b,c,d,e,f\nTitle,,,,keep,1\n,,,,keep2,2\n\na,b,c,d,e,f\n1,2,3,4,#N/A,6\n")
    got = csv.read_sheet(spark, f"{tmp_path}/sheet.csv", skip=2)
    assert got.columns == list("abcdef")
    assert {(r["e"], r["f"]) for r in got.collect()} == {("keep", "1"), ("keep2", "2"), ("e", "f"), (None, "6")}


def test_each_snapshot_is_read_by_its_own_header(spark, tmp_path):
    put(tmp_path, "01-01-2020.csv", "Country_Region,Confirmed,Deaths\nX,10,1\n")
    put(tmp_path, "01-02-2020.csv", "Confirmed,Country_Region,Deaths\n20,X,2\n")
    put(tmp_path, "01-03-2020.csv", "FIPS,Country_Region,Confirmed\n9,X,30\n")
    kinds = {"Country_Region": "string", "Confirmed": "bigint", "Deaths": "bigint"}
    got = csv.read_snapshots(spark, str(tmp_path), kinds).orderBy("Date").collect()
    assert [tuple(r)[:3] for r in got] == [("X", 10, 1), ("X", 20, 2), ("X", 30, None)]
    with pytest.raises(ValueError, match="Active"):
        csv.read_snapshots(spark, str(tmp_path), {"Active": "bigint"})
    with pytest.raises(Exception, match="header"):
        csv.read_flat(spark, [f"{tmp_path}/01-01-2020.csv", f"{tmp_path}/01-02-2020.csv"]).collect()


def test_wide_form_stops_on_repeats_and_unlisted_names(spark):
    df = spark.createDataFrame([("e", "x", 1), ("e", "x", 5), ("e", "z", 7)], "id string, n string, v int")
    with pytest.raises(PySparkException, match="more than once"):
        reshape.to_wide(df.where("n = 'x'"), ["id"], "n", ["x", "y"], ["v"]).collect()
    with pytest.raises(PySparkException, match="not listed"):
        reshape.to_wide(df.where("v > 1"), ["id"], "n", ["x", "y"], ["v"]).collect()
    got = reshape.to_wide(df.where("v > 1"), ["id"], "n", ["x", "y"], ["v"], other="drop").first()
    assert tuple(got) == ("e", 5, None)
    twice = spark.createDataFrame([("e", "i", "1"), ("e", "i", "2")], "c string, i string, `2000` string")
    with pytest.raises(PySparkException, match="more than once"):
        reshape.transpose_indicators(twice, "c", "i", ["2000"], ["i"]).collect()


def test_a_day_in_several_files_is_summed(spark, tmp_path):
    put(f"{tmp_path}/in", "a-01-01-2020.csv", "k,v\ne,10\n")
    put(f"{tmp_path}/in", "b-01-01-2020.csv", "k,v\ne,5\n")
    for value in (15, 99):
        stream = ingest.stream_snapshots(spark, f"{tmp_path}/in", "k string, v bigint")
        ingest.start_ingest(stream, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
        got = ingest.read_latest(spark, f"{tmp_path}/log", ["k", "Date"], ["v"]).first()
        assert got["v"] == value
        put(f"{tmp_path}/in", "c-01-01-2020.csv", "k,v\ne,99\n")


def test_joins_and_mappings(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("b", 3), (None, 4)], "k string, y int")
    assert {tuple(r) for r in joins.full_join(left, right, ["k"]).collect()} == {("a", 1, None), (None, 2, 4), ("b", None, 3)}
    mapping = spark.createDataFrame([("a", "p"), ("a", "q")], "f string, t string")
    with pytest.raises(PySparkException, match="repeats"):
        keys.recode_from(left, "k", mapping, "f", "t").collect()


def test_a_stream_never_mixes_up_swapped_columns(spark, tmp_path):
    """A later delivery in another order is read by its names; two orders in one delivery stop the stream."""
    (tmp_path / "in").mkdir()

    def ingested(name="log"):
        stream = ingest.stream_snapshots(spark, f"{tmp_path}/in", "k string, v bigint")
        ingest.start_ingest(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
        return sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())

    (tmp_path / "in" / "01-02-2020.csv").write_text("k,v\na,1\n")
    assert ingested() == [("a", 1)]
    (tmp_path / "in" / "01-03-2020.csv").write_text("v,k\n5,much longer than the other file\n")
    assert ingested() == [("a", 1), ("much longer than the other file", 5)]
    with pytest.raises(Exception, match="(?i)header"):
        ingested("both")


def test_a_stream_finds_columns_by_name_or_by_position(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "01-02-2020.csv").write_text("v,k\n1,a\n")
    for schema, expected in (("k string, v bigint", ("a", 1)), ("n bigint, name string", (1, "a"))):
        state = tmp_path / schema[0]
        stream = ingest.stream_snapshots(spark, f"{tmp_path}/in", schema)
        ingest.start_ingest(stream, f"{state}/log", f"{state}/state").awaitTermination()
        assert tuple(spark.read.parquet(f"{state}/log").first())[:2] == expected
    with pytest.raises(ValueError, match="columns"):
        ingest.stream_snapshots(spark, f"{tmp_path}/in", "k string")
