"""Run registered queries next to their SQL twins: ``python tools/compare.py <sf_dir> [name prefix ...]``.

``COMPARE_CONF="key=value key=value"`` adds Spark settings, e.g. to try the plans without any broadcast join.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from panelyard import plans  # noqa: E402
from panelyard.session import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def canonical(columns, rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float, str]:
    start = time.time()
    df = plans.queries()[name](spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - start
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return "rows only", len(rows), seconds, ""
    cursor = con.execute(sql)
    expected = canonical([d[0] for d in cursor.description], cursor.fetchall())
    got = canonical(df.columns, rows)
    if got[0] != expected[0]:
        return "COLUMNS", len(rows), seconds, f"{got[0]} vs {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return "ROWS", len(rows), seconds, f"{len(got[1])} vs {len(expected[1])}: {got[1][:2]} {expected[1][:2]}"
    wrong = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    if wrong:
        return "VALUES", len(rows), seconds, f"{len(wrong)} rows, e.g. {wrong[0]}"
    return "ok", len(rows), seconds, ""


def main() -> int:
    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = get_session(
        "compare", "local[8]", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                "spark.ui.showConsoleProgress": "false",
                                **dict(pair.split("=", 1) for pair in os.environ.get("COMPARE_CONF", "").split() if pair)}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in plans.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            status, rows, seconds, note = compare(spark, con, name, sf_dir)
        except Exception as error:
            status, rows, seconds, note = "ERROR", 0, 0.0, str(error)[:700]
        bad += status not in ("ok", "rows only")
        print(f"{status:10} {name:32} {rows:7} rows {seconds:6.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
