"""Map features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text fields take whole JSON values: all properties, and coordinates of any depth.
GEO_SCHEMA = "features array<struct<properties: string, geometry: struct<type: string, coordinates: string>>>"


def read_features(spark: SparkSession, path: str, schema: str = GEO_SCHEMA, multi_line: bool = True) -> DataFrame:
    """One row per feature of feature-collection documents: one document per file, or per line with
    ``multi_line=False`` (which keeps large files splittable)."""
    return explode_features(spark.read.option("multiLine", multi_line).schema(schema).json(path))


def explode_features(collections: DataFrame) -> DataFrame:
    """name, geometry_type, coordinates and properties of each feature; the last two as JSON text."""
    return collections.select(F.explode("features").alias("f")).select(
        F.get_json_object("f.properties", "$.name").alias("name"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
        F.col("f.properties").alias("properties"),
    )
