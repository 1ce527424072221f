"""Sinks. Executors write their partitions; only ``collect`` brings rows to the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """A file for each partition. ``overwrite`` replaces the whole folder, so that no older part survives."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Files with a header each; null is an empty cell."""
    df.write.mode(mode).option("header", True).csv(path)


def show(df: DataFrame, n: int = 20) -> str:
    """The first ``n`` rows as a text table; no more than these are computed where the plan allows it."""
    return df._show_string(n, truncate=False, vertical=False)


def collect(df: DataFrame) -> list[dict[str, Any]]:
    """All rows as dictionaries, in partition order. For results of a known small size."""
    return [row.asDict() for row in df.collect()]
