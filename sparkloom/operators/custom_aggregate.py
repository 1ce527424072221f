"""Aggregates written in Python: partial states before the exchange, merged ones after it."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class AggregateFunction(ABC):
    """The contract of an aggregate. States are any picklable values; their size must not grow with the group."""

    #: Spark type of the result, as a DDL name.
    result_type: str = "double"

    @abstractmethod
    def initialize(self) -> Any:
        """The state of no rows."""

    @abstractmethod
    def update(self, state: Any, value: Any) -> Any:
        """The state after one more value (which may be None)."""

    @abstractmethod
    def merge(self, left: Any, right: Any) -> Any:
        """The state of both inputs together; the order of merging must not matter."""

    @abstractmethod
    def finalize(self, state: Any) -> Any:
        """The result."""


#: States that a task holds before it hands them to the exchange, which spills; a key met again then has a second state.
MAX_STATES = 100_000
#: All NaN keys are one group: a dictionary finds one and the same object, but no other NaN.
_NAN = float("nan")


def custom_aggregate(df: DataFrame, keys: Sequence[str], column: str, function: AggregateFunction, name: str) -> DataFrame:
    """One row for each combination of keys: the keys and the function's result under ``name``.

    Each task folds its rows into one state for each key it meets, and passes the states on whenever it holds MAX_STATES of
    them, so its memory does not grow with the number of keys. States, not rows, are shuffled: a hot key costs one state a
    task and pass. Built-in aggregates are far faster: use this only for what they cannot say.
    """
    if not keys:
        raise ValueError("grouping needs a key")
    key_fields = [df.schema[k] for k in keys]
    partial = T.StructType([*key_fields, T.StructField("__state", T.BinaryType())])
    final = T.StructType([*key_fields, T.StructField(name, T._parse_datatype_string(function.result_type))])
    kinds = [to_arrow_type(f.dataType) for f in key_fields]
    width, most = len(keys), MAX_STATES
    floating = [k for k, f in enumerate(key_fields) if isinstance(f.dataType, T.DoubleType | T.FloatType)]

    def handed_on(states: dict[tuple, Any]) -> pa.RecordBatch:
        made = [pa.array([k[i] for k in states], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*made, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*keys, "__state"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            for k in floating:
                values[k] = [_NAN if x != x else x for x in values[k]]
            for key, value in zip(zip(*values[:width], strict=True), values[width], strict=True):
                states[key] = function.update(states[key] if key in states else function.initialize(), value)
            if len(states) >= most:
                yield handed_on(states)
                states = {}
        yield handed_on(states)

    def finish(table: pa.Table) -> pa.Table:
        state = function.initialize()
        for blob in table.column("__state"):
            state = function.merge(state, pickle.loads(blob.as_py()))
        made = pa.array([function.finalize(state)], to_arrow_type(final[name].dataType))
        return pa.table([*[table.column(k).slice(0, 1) for k in keys], made], names=[*keys, name])

    states = df.select(*keys, F.col(column)).mapInArrow(fold, partial)
    return states.groupBy(*keys).applyInArrow(finish, final)
