"""Grouped and global aggregation: partial sums before the exchange, final ones after it, by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .project import distinct_names


def group(df: DataFrame, keys: Sequence[str | Column], *aggregates: Column) -> DataFrame:
    """One row for each combination of keys (null is a value of its own): the keys, then the aggregates."""
    if not keys or not aggregates:
        raise ValueError("grouping needs a key and an aggregate")
    return distinct_names(df.groupBy(*keys).agg(*aggregates))


def aggregate(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row over the whole table, even an empty one (counts are 0 there, the rest null)."""
    if not aggregates:
        raise ValueError("an aggregation needs an aggregate")
    return distinct_names(df.agg(*aggregates))


def distinct_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Grouping without aggregates: each combination of keys once."""
    if not keys:
        raise ValueError("grouping needs a key")
    return df.select(*keys).distinct()
