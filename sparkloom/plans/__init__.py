"""Plans as text, and questions that tests ask about them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def explain(df: DataFrame, optimized: bool = False) -> str:
    """The logical plan as written; with ``optimized`` also the analysed, optimised and physical ones. Nothing is run."""
    execution = df._jdf.queryExecution()
    return execution.toString() if optimized else execution.logical().toString()


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pushed_filters(df: DataFrame) -> list[str]:
    """The predicates that reached file scans."""
    return [x for found in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", physical(df)) for x in re.split(r", (?![^(]*\))", found) if x]


def read_columns(df: DataFrame) -> list[str]:
    """The columns that file scans read, in the order of the scans."""
    return [c.split(":")[0] for found in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$|,? )", physical(df)) for c in found.split(",") if c]


def join_strategies(df: DataFrame) -> list[str]:
    return re.findall(r"(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|CartesianProduct)", physical(df))


def estimated_bytes(df: DataFrame) -> int:
    """The size that the optimiser assumes for the rows of ``df``: files' sizes, narrowed by the columns and filters it knows
    of. Nothing is run. Joins choose a broadcast side by this number."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
