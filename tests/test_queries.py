"""Every panel query next to its SQL twin at the smallest scale."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

from panelyard import plans  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["nation", "day"] and df.count() > 0


def test_names_line_up():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    status, _, _, note = compare.compare(spark, con, name, SF_DIR)
    assert status == "ok", note


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, con, name):
    status, rows, _, note = compare.compare(spark, con, name, SF_DIR)
    assert status == "rows only" and rows > 0, note
