"""Expressions: Spark's own, by short names, and the null-safe and string forms that operators alone cannot say."""

from pyspark.sql import Column
from pyspark.sql import functions as F

col, lit = F.col, F.lit
count, sum, avg, min, max = F.count, F.sum, F.avg, F.min, F.max  # noqa: A001
udf, pandas_udf = F.udf, F.pandas_udf

__all__ = ["avg", "col", "concat", "count", "divide", "lit", "max", "min", "null_safe_eq", "null_safe_ne", "pandas_udf", "sum", "udf"]


def null_safe_eq(left: Column, right: Column) -> Column:
    """True if both are equal or both null; never null."""
    return left.eqNullSafe(right)


def null_safe_ne(left: Column, right: Column) -> Column:
    """True if they differ or just one is null; never null."""
    return ~left.eqNullSafe(right)


def divide(left: Column, right: Column) -> Column:
    """True division; null where the divisor is 0 (plain ``/`` raises there)."""
    return F.try_divide(left, right)


def concat(*parts: Column) -> Column:
    """Strings one after another; null if any is null."""
    return F.concat(*parts)
