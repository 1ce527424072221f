"""CSV and Parquet readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False, sample: float = 1.0) -> DataFrame:
    """A file or folder with a header line. Empty cells are null; a row that does not fit the schema fails the query.

    Without a schema the types are inferred in an extra pass over the data, from the share ``sample`` of the rows: give a
    schema for anything large, or a small share (a value that does not fit the types then fails the query). ``multiline``
    reads line breaks inside quotes, at the price of one task for each file.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", multiline).option("enforceSchema", schema is None)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True).option("samplingRatio", sample)).csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files or folders. Filters and the choice of columns reach the scan; row groups are split over tasks."""
    if not paths:
        raise ValueError("a path is needed")
    return spark.read.parquet(*paths)
