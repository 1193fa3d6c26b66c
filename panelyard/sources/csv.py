"""Delimited files: flat tables, dated snapshots, sheets with a preamble."""

from __future__ import annotations

import csv as _csv
import datetime as dt
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.dates import parse_mdy

Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_flat(
    spark: SparkSession,
    paths: Paths,
    columns: Mapping[str, str] | None = None,
    null_value: str | None = "NA",
    row_index: bool = False,
) -> DataFrame:
    """A file with a header line. ``{column: type}`` picks columns by their raw header and casts them
    tolerantly; without it every column is text. ``row_index`` drops a leading row-number column."""
    # Headers are checked: of several files, one with other columns or another order stops the read.
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    df = reader.csv(_paths(paths))
    if row_index:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns[1:]])
    if columns:
        df = df.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in columns.items()])
    return df


def read_sheet(
    spark: SparkSession, path: str, skip: int = 0, null_value: str | None = "#N/A", names: Sequence[str] | None = None
) -> DataFrame:
    """A sheet exported as CSV with ``skip`` lines above the header line; all columns are text.

    The driver looks at the first ``skip + 1`` lines only. The scan itself stays splittable: those lines are left
    out by their position in the file, blank ones included, and no data row is compared with them.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    header = list(names) if names else None
    if header is None:
        top = [r.value for r in spark.read.text(path).limit(skip + 1).collect()]
        header = next(_csv.reader([top[skip].lstrip("\ufeff")]))
    # Lines of a split are numbered without gaps, so the first line's number gives each position in the first split.
    first = lines.filter(F.col("_block") == 0).groupBy("_file").agg(F.min("_line").alias("_first"))
    place = F.col("_line") - F.col("_first")
    body = lines.join(first, "_file").filter(((F.col("_block") > 0) | (place > skip)) & (F.trim("value") != ""))
    raw = [f"_c{i}" for i in range(len(header))]
    options = {"nullValue": null_value} if null_value is not None else {}
    parsed = F.from_csv("value", ", ".join(f"{c} string" for c in raw), options)
    return body.select(parsed.alias("_row")).select(*[F.col(f"_row.{c}") for c in raw]).toDF(*header)


def snapshot_paths(base: str, start: dt.date, end: dt.date, pattern: str = "%m-%d-%Y.csv") -> list[str]:
    """One path per day from ``start`` to ``end``, both included."""
    days = (end - start).days + 1
    return [f"{base.rstrip('/')}/{(start + dt.timedelta(days=i)).strftime(pattern)}" for i in range(days)]


def date_spine(df: DataFrame, time: str, into: str = "date") -> DataFrame:
    """Every calendar day between the first and the last time of ``df``."""
    return df.agg(F.explode(F.sequence(F.min(time), F.max(time), F.expr("interval 1 day"))).alias(into))


FILE_DATE = r"(\d{2}-\d{2}-\d{4})(?!.*\d{2}-\d{2}-\d{4})"


def read_snapshots(
    spark: SparkSession,
    paths: Paths,
    columns: Mapping[str, str],
    renames: Mapping[str, str] | None = None,
    date: str = "Date",
    file_date: str = FILE_DATE,
    date_format: str = "MM-dd-yyyy",
) -> DataFrame:
    """Dated files: the day comes from the file name and becomes a column.

    ``columns`` picks raw headers with their types, ``renames`` brings one era's headers to the common names. Each
    file is read by its own header: files that share one are one scan, and a column that a file lacks is missing
    there. A column that no file has stops the read.
    """
    groups = _files_by_header(spark, _paths(paths))
    unknown = [c for c in columns if not any(c in header for header in groups)]
    if unknown:
        raise ValueError(f"no file has the columns {unknown}")
    parts = []
    for header, files in groups.items():
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(files)
        picked = [
            (F.col(f"`{c}`").try_cast(kind) if c in header else F.lit(None).cast(kind)).alias(c)
            for c, kind in columns.items()
        ]
        day = parse_mdy(F.regexp_extract(F.col("_metadata.file_path"), file_date, 1), date_format).alias(date)
        parts.append(raw.select(*picked, day))
    return stack_eras(parts).withColumnsRenamed(dict(renames or {}))


def _files_by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their header line; one row per file reaches the driver."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in first.orderBy("file").collect():
        header = tuple(next(_csv.reader([r["header"].lstrip("\ufeff")])))
        groups.setdefault(header, []).append(unquote(r["file"]))
    if not groups:
        raise ValueError("no file with a header line")
    return groups


def stack_eras(eras: Sequence[DataFrame]) -> DataFrame:
    """Union by name of eras that already share their column names."""
    stacked = eras[0]
    for era in eras[1:]:
        stacked = stacked.unionByName(era)
    return stacked
