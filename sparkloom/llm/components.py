"""Connected components of an edge list by alternating large-star and small-star steps, without collecting any edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that one task reads, about: small graphs are not spread over more tasks than that, whatever the session's
#: number of shuffle partitions.
TASK_EDGES = 50_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (columns u and v, longs): label is the component's smallest vertex.

    Self-loops and repeated edges do no harm; a null end raises nothing and is left out. Each step groups by vertex with
    partial minima and joins back, so a vertex with very many edges is pre-aggregated and its join can be split.
    """
    pairs = edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = checkpoint(pairs.where("u != v").distinct())
    before = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, tasks = now, max(1, -(-now[0] // TASK_EDGES))
        state = state.coalesce(tasks)
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").coalesce(tasks)
        state = checkpoint(small.distinct().coalesce(tasks))
    roots = state.select(F.col("v").alias("label")).distinct().select(F.col("label").alias("v"), "label")
    return state.select(F.col("u").alias("v"), F.col("v").alias("label")).union(roots)
