"""Incremental ingest of dated snapshot files.

Every micro-batch is written to its own ``batch=<id>`` folder in overwrite mode, so a batch that is replayed
after a failure replaces itself. Reading takes, per (entity, date), the rows of the latest batch: a late or
corrected delivery wins over what came before without touching old files.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelyard.functions.dates import parse_mdy
from panelyard.sources.csv import FILE_DATE


def _layout(spark: SparkSession, path: str, schema: T.StructType, glob: str | None) -> T.StructType:
    """``schema`` with the columns as the header of a file that is there names and orders them."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    first = reader.text(path).where("_metadata.file_block_start = 0").select("value").first()
    if first is None:
        return schema
    header = next(csv.reader([first["value"].lstrip("\ufeff")]))
    if len(header) != len(schema.fields):
        raise ValueError(f"the files have the columns {header}, not {schema.fieldNames()}")
    if set(header) == set(schema.fieldNames()):
        return T.StructType([schema[name] for name in header])
    return T.StructType([T.StructField(name, f.dataType) for name, f in zip(header, schema.fields, strict=True)])


def stream_snapshots(
    spark: SparkSession, path: str, schema: str, date: str = "Date", file_date: str = FILE_DATE, glob: str | None = None
) -> DataFrame:
    """Streaming scan of CSV snapshots with the day taken from the file name and the file's own time.

    Columns are found by the names of ``schema``; where the headers use other names, ``schema`` names the columns by
    position. All files of a stream share one header: one with other columns or another order stops the stream.
    """
    wanted = T.StructType.fromDDL(schema)
    layout = _layout(spark, path, wanted, glob)
    named = set(layout.fieldNames()) == set(wanted.fieldNames())
    reader = spark.readStream.schema(layout).option("header", True).option("enforceSchema", False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    sources = wanted.fieldNames() if named else layout.fieldNames()
    rows = reader.csv(path)
    found = [F.col(f"`{source}`").alias(name) for source, name in zip(sources, wanted.fieldNames(), strict=True)]
    others = [F.col(f"`{c}`") for c in rows.columns if c not in layout.fieldNames()]  # those of folder names
    return rows.select(
        *found,
        *others,
        parse_mdy(F.regexp_extract(F.col("_metadata.file_path"), file_date, 1)).alias(date),
        F.col("_metadata.file_modification_time").alias("_file_time"),
    )


def start_ingest(snapshots: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append all files that are there now to the log table, then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        snapshots.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, table: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The current panel: per key the sums over all rows of its latest batch.

    A batch is one delivery of a day: the day may lie in several files, and rows of one key (sub-areas of an entity)
    are summed. A corrected delivery belongs into a later batch.
    """
    log = spark.read.option("basePath", table).parquet(table)
    versions = log.groupBy(*keys, "batch").agg(*[F.sum(m).alias(m) for m in measures])
    return versions.groupBy(*keys).agg(*[F.max_by(m, "batch").alias(m) for m in measures])
