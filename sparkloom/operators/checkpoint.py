"""Checkpoints: a table written whole, and a plan that starts from it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def checkpoint(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet now and return a table that reads it: its plan is a scan, whatever made it is forgotten.

    Without a path a fresh one in the shared folder is used. The path is overwritten, so it must not be one that ``df``
    reads from. Files stay until someone deletes them.
    """
    place = path or scratch_path(df.sparkSession, "checkpoint")
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
