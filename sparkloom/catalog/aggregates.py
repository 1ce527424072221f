"""Grouped and global aggregation. Sums of doubles go through exact decimals, so that their order does not matter."""

from pyspark.sql import functions as F

from ..functions import col, lit
from ..operators import AggregateFunction, aggregate, custom_aggregate, distinct_groups, group, select, where
from ..sources import table
from .registry import query


def exact(column: str):
    return F.sum(col(column).cast("decimal(18,2)")).cast("double")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def agg_count_star(spark, sf_dir):
    return group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS parts, count(nullif(p_size, 10)) AS sized FROM part GROUP BY p_brand")
def agg_count_col_nulls(spark, sf_dir):
    return group(table(spark, sf_dir, "part"), ["p_brand"], F.count("*").alias("parts"), F.count(F.nullif("p_size", lit(10))).alias("sized"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark, sf_dir):
    return group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], exact("l_quantity").alias("quantity"), F.sum("l_linenumber").alias("lines"))


@query("SELECT p_brand, avg(p_size) AS mean_size FROM part GROUP BY p_brand")
def agg_avg(spark, sf_dir):
    return group(table(spark, sf_dir, "part"), ["p_brand"], F.avg("p_size").alias("mean_size"))


@query("SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment")
def agg_min_max(spark, sf_dir):
    return group(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("SELECT n_regionkey, min(n_name) AS first_name, max(n_name) AS last_name FROM nation GROUP BY n_regionkey")
def agg_min_max_string(spark, sf_dir):
    return group(table(spark, sf_dir, "nation"), ["n_regionkey"], F.min("n_name").alias("first_name"), F.max("n_name").alias("last_name"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_shipdate) AS last_day FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_multi_key(spark, sf_dir):
    return group(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.max("l_shipdate").alias("last_day"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber * 2 + 1) AS BIGINT) AS odd, max(l_extendedprice * l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def agg_expression(spark, sf_dir):
    return group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.sum(col("l_linenumber") * 2 + 1).alias("odd"), F.max(col("l_extendedprice") * col("l_quantity")).alias("most"))


@query("SELECT nullif(p_brand, 'Brand#11') AS brand, count(*) AS parts FROM part GROUP BY nullif(p_brand, 'Brand#11')")
def agg_null_group_key(spark, sf_dir):
    return group(table(spark, sf_dir, "part"), [F.nullif("p_brand", lit("Brand#11")).alias("brand")], F.count("*").alias("parts"))


@query("SELECT p_brand, CAST(sum(nullif(p_size, p_size)) AS BIGINT) AS nothing, avg(nullif(p_size, p_size)) AS none, min(nullif(p_size, p_size)) AS least FROM part GROUP BY p_brand")
def agg_all_null_sum(spark, sf_dir):
    empty = select(table(spark, sf_dir, "part"), "p_brand", F.nullif("p_size", col("p_size")).alias("x"))
    return group(empty, ["p_brand"], F.sum("x").alias("nothing"), F.avg("x").alias("none"), F.min("x").alias("least"))


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(o_orderdate) AS first_day FROM orders")
def agg_global(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "orders"), F.count("*").alias("n"), exact("o_totalprice").alias("total"), F.min("o_orderdate").alias("first_day"))


@query("SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, avg(p_size) AS mean FROM part WHERE p_size < 0")
def agg_global_empty(spark, sf_dir):
    return aggregate(where(table(spark, sf_dir, "part"), col("p_size") < 0), F.count("*").alias("n"), F.sum("p_size").alias("total"), F.avg("p_size").alias("mean"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def agg_group_only_distinct(spark, sf_dir):
    return distinct_groups(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT lines, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) GROUP BY lines")
def agg_of_agg(spark, sf_dir):
    lines = group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.count("*").alias("lines"))
    return group(lines, ["lines"], F.count("*").alias("orders"))


@query("SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey HAVING count(*) > 55")
def agg_having(spark, sf_dir):
    return where(group(table(spark, sf_dir, "customer"), ["c_nationkey"], F.count("*").alias("customers")), col("customers") > 55)


class Spread(AggregateFunction):
    """Greatest minus least value; null where there is none."""

    result_type = "int"

    def initialize(self):
        return None

    def update(self, state, value):
        return state if value is None else self.merge(state, (value, value))

    def merge(self, left, right):
        return right if left is None else left if right is None else (min(left[0], right[0]), max(left[1], right[1]))

    def finalize(self, state):
        return None if state is None else state[1] - state[0]


@query("SELECT nullif(p_brand, 'Brand#11') AS brand, max(nullif(p_size, 10)) - min(nullif(p_size, 10)) AS spread FROM part GROUP BY nullif(p_brand, 'Brand#11')")
def agg_custom_function(spark, sf_dir):
    parts = select(table(spark, sf_dir, "part"), F.nullif("p_brand", lit("Brand#11")).alias("brand"), F.nullif("p_size", lit(10)).alias("size"))
    return custom_aggregate(parts, ["brand"], "size", Spread(), "spread")
