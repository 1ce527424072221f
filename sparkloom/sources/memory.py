"""Rows given as dictionaries."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def from_rows(spark: SparkSession, rows: Sequence[dict[str, Any]], schema: T.StructType | str | None = None, partitions: int = 4) -> DataFrame:
    """A table of the rows in at most ``partitions`` partitions.

    Without a schema the columns are those of the first row and types are inferred from all rows; no rows and no schema
    raise ValueError. A missing key is null.
    """
    if not rows and schema is None:
        raise ValueError("no rows to infer a schema from")
    if partitions < 1:
        raise ValueError("the number of partitions must be positive")
    if schema is None:
        names = list(rows[0])
        data = [tuple(r.get(c) for c in names) for r in rows]
        df = spark.createDataFrame(data, names, samplingRatio=1.0)
    else:
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        df = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)
    return df.coalesce(min(partitions, max(1, len(rows))))
