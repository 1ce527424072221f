"""Where rows lie. None of these changes what a table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .sort import sort_keys


def _positive(n: int) -> int:
    if n < 1:
        raise ValueError("the number of partitions must be positive")
    return n


def repartition(df: DataFrame, n: int) -> DataFrame:
    """Evenly over ``n`` partitions, round-robin."""
    return df.repartition(_positive(n))


def repartition_by_hash(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """Rows with equal columns in one of ``n`` partitions; a later join or grouping on them needs no further exchange."""
    if not columns:
        raise ValueError("hashing needs a column")
    return df.repartition(_positive(n), *columns)


def repartition_by_range(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """Contiguous ranges of the columns, balanced by a sample; nulls are in the last one."""
    return df.repartitionByRange(_positive(n), *sort_keys(columns))
