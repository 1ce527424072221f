"""Table statistics in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_statistics(df: DataFrame, columns: Sequence[str] | None = None, approximate: float | None = None) -> DataFrame:
    """A row for each column: ``column``, ``row_count``, ``null_count``, ``distinct_count`` (non-null), ``min`` and ``max`` as text.

    All of it is one aggregation over one scan of the given columns. Exact distinct counts of many columns expand the rows
    once a column and shuffle the values; ``approximate`` (a relative error such as 0.02) takes a sketch instead, which stays
    small at any size. Columns without an order have null bounds.
    """
    names = list(df.columns if columns is None else columns)
    if not names:
        raise ValueError("statistics need a column")
    kinds = dict(df.dtypes)
    parts = []
    for k, name in enumerate(names):
        value = F.col(f"`{name}`")
        ordered = not kinds[name].startswith(("map", "variant"))
        bounds = [F.to_json(F.struct(f(value).alias("x"))) if kinds[name].startswith(("array", "struct")) else f(value).cast("string") for f in (F.min, F.max)]
        many = F.approx_count_distinct(value, approximate) if approximate else F.count_distinct(value)
        parts += [
            F.count(F.when(value.isNull(), 1)).alias(f"nulls{k}"),
            many.alias(f"distinct{k}"),
            (bounds[0] if ordered else F.lit(None).cast("string")).alias(f"min{k}"),
            (bounds[1] if ordered else F.lit(None).cast("string")).alias(f"max{k}"),
        ]
    whole = df.agg(F.count("*").alias("row_count"), *parts)
    rows = [
        F.struct(F.lit(name).alias("column"), F.col("row_count"), F.col(f"nulls{k}").alias("null_count"), F.col(f"distinct{k}").alias("distinct_count"), F.col(f"min{k}").alias("min"), F.col(f"max{k}").alias("max"))
        for k, name in enumerate(names)
    ]
    return whole.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
