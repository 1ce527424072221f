"""Projection and filter, with the one check that Spark leaves out: output names must differ."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame

from ..errors import PlanError


def distinct_names(df: DataFrame) -> DataFrame:
    """``df`` itself; PlanError if two of its columns have the same name (in any case: Spark resolves names so)."""
    twice = sorted(name for name, n in Counter(c.lower() for c in df.columns).items() if n > 1)
    if twice:
        raise PlanError(f"output names must differ; repeated: {', '.join(twice)}")
    return df


def select(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The given columns or expressions, at least one. Computed ones should have an alias."""
    if not columns:
        raise ValueError("select needs a column")
    return distinct_names(df.select(*columns))


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; null counts as not true."""
    return df.where(condition)
