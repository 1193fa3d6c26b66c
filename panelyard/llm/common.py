"""What several operators of this subpackage share: input columns, stored tables, constants of the text model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.session import shared_path

# Words are runs of anything but ASCII white space. bytes.split() cuts at exactly these characters.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, a missing text as an empty one. Other columns can clash with nothing downstream."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces_of(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, cut when ``column`` reaches ``most_bytes``; one row is never cut."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch[column]).fill_null(0).to_pylist()
        start = total = 0
        for k, size in enumerate(sizes):
            if total and total + size > most_bytes:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
