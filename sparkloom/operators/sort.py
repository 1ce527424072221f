"""Global order. Nulls come last in both directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_keys(columns: Sequence[str], ascending: bool | Sequence[bool] = True) -> list[Column]:
    """Order expressions with nulls last; ``ascending`` is one flag for all columns or one for each."""
    if not columns:
        raise ValueError("an order needs a column")
    flags = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(columns):
        raise ValueError(f"{len(columns)} columns but {len(flags)} directions")
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(columns, flags, strict=True)]


def sort(df: DataFrame, *columns: str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """The rows in order: a sampled range exchange, then a sort of each partition."""
    return df.orderBy(*sort_keys(columns, ascending))


def head(df: DataFrame, n: int, *columns: str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """The first ``n`` rows in the order: each partition keeps ``n``, no full sort."""
    if n < 0:
        raise ValueError("n must not be negative")
    return sort(df, *columns, ascending=ascending).limit(n)
