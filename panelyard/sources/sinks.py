"""Writers for stage tables and user exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), file_format: str = "parquet", mode: str = "overwrite"
) -> str:
    writer = df.write.mode(mode).format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def export_table(df: DataFrame, path: str, columns: Sequence[str]) -> str:
    """The named columns of the whole table as CSV with a header."""
    return write_table(df.select(*columns), path, file_format="csv")


def export_by_entity(df: DataFrame, path: str, entity: str) -> str:
    """All columns, one folder of CSV files per entity, in one job without a shuffle: each task writes the
    entities it holds, so a large entity is written by many tasks."""
    return write_table(df, path, partition_by=[entity], file_format="csv")


def write_snapshots(df: DataFrame, path: str, date_text: str) -> str:
    """CSV files below one folder per day; :func:`panelyard.sources.csv.read_snapshots` reads them back."""
    return write_table(df, path, partition_by=[date_text], file_format="csv")
