"""Partitioning and statistics: the content stays the same, whatever the layout."""

from ..functions import count
from ..operators import repartition, repartition_by_hash, repartition_by_range, select, table_statistics
from ..sources import table
from ..streaming import tumbling_counts
from .registry import query


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def repartition_round_robin(spark, sf_dir):
    return repartition(select(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"), 7)


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def repartition_hash(spark, sf_dir):
    customers = repartition_by_hash(select(table(spark, sf_dir, "customer"), "c_custkey"), 6, "c_custkey")
    orders = repartition_by_hash(table(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey"), 6, "c_custkey")
    return customers.join(orders, "c_custkey").groupBy("c_custkey").agg(count("o_orderkey").alias("orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def repartition_range(spark, sf_dir):
    return repartition_by_range(select(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice"), 5, "o_totalprice")


def _statistics_sql(name: str, columns: dict[str, str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({x}) AS null_count, count(DISTINCT {x}) AS distinct_count, min({x})::VARCHAR AS min, max({x})::VARCHAR AS max FROM {name}" for c, x in columns.items()]
    return " UNION ALL ".join(parts)


@query(_statistics_sql("part", {"p_partkey": "p_partkey", "p_name": "p_name", "p_brand": "nullif(p_brand, 'Brand#11')", "p_size": "nullif(p_size, 10)"}))
def statistics_of_part(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "nullif(p_brand, 'Brand#11') AS p_brand", "nullif(p_size, 10) AS p_size")
    return table_statistics(part)


@query(_statistics_sql("nation", {c: c for c in ("n_nationkey", "n_name", "n_regionkey")}))
def statistics_of_nation(spark, sf_dir):
    return table_statistics(table(spark, sf_dir, "nation"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_hour(spark, sf_dir):
    """A streaming extension, run here as a batch."""
    events = table(spark, sf_dir, "events").selectExpr("cast(ts AS timestamp) AS ts", "event_type")
    return tumbling_counts(events, "ts", "event_type", "1 hour", "10 minutes").selectExpr("cast(window_start AS timestamp_ntz) AS window_start", "event_type", "n")
