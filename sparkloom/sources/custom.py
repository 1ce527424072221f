"""Sources of one's own: Spark's Python data sources, registered by name."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource


def read_custom(spark: SparkSession, source: type[DataSource], **options: Any) -> DataFrame:
    """The table that a DataSource subclass reads. Its partitions are read by executors; filters and column choices that it
    does not take over are applied by Spark, so a source may ignore them."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
