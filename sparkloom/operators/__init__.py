"""Relational operators over DataFrames."""

from .aggregate import aggregate, distinct_groups, group
from .checkpoint import checkpoint
from .custom_aggregate import AggregateFunction, custom_aggregate
from .event_log import last_run_metrics, read_events, session_events, stage_metrics, task_metrics
from .join import join
from .metrics import QueryMetrics, StageMetrics, measured
from .partition import repartition, repartition_by_hash, repartition_by_range
from .project import select, where
from .sort import head, sort, sort_keys
from .statistics import table_statistics

__all__ = [
    "AggregateFunction",
    "QueryMetrics",
    "StageMetrics",
    "aggregate",
    "checkpoint",
    "custom_aggregate",
    "distinct_groups",
    "group",
    "head",
    "join",
    "last_run_metrics",
    "measured",
    "read_events",
    "repartition",
    "repartition_by_hash",
    "repartition_by_range",
    "select",
    "session_events",
    "sort",
    "sort_keys",
    "stage_metrics",
    "table_statistics",
    "task_metrics",
    "where",
]
