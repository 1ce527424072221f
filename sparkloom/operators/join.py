"""Inner equi-joins on columns of the same name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError

#: How each strategy is asked for. ``auto`` leaves it to sizes and to what is measured while the query runs.
STRATEGIES = {"auto": None, "broadcast": "broadcast", "shuffle_hash": "shuffle_hash", "sort_merge": "merge"}


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], strategy: str = "auto", null_safe: bool = False) -> DataFrame:
    """Rows of both sides whose ``on`` columns are equal: all columns of the left, then the right's others.

    ``null_safe`` lets null keys match each other. Missing keys and other columns that both sides have raise PlanError.
    ``broadcast`` sends the whole right side to every executor: ask for it only where its size is known to be small.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not keys:
        raise ValueError("a join needs a key")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    for side, df in (("left", left), ("right", right)):
        if missing := [k for k in keys if k not in df.columns]:
            raise PlanError(f"{side} side lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    if both := sorted((set(left.columns) & set(right.columns)) - set(keys)):
        raise PlanError(f"both sides have {', '.join(both)}; rename or drop one")
    hint = STRATEGIES[strategy]
    others = [c for c in right.columns if c not in keys]
    if null_safe:
        renamed = right.select(*[F.col(f"`{k}`").alias(f"__right_{k}") for k in keys], *[f"`{c}`" for c in others])
        condition = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__right_{k}`")) for k in keys])
        joined = left.join(renamed.hint(hint) if hint else renamed, condition)
    else:
        joined = left.join(right.hint(hint) if hint else right, keys)
    return joined.select(*[f"`{c}`" for c in [*left.columns, *others]])
