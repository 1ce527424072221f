"""Projection and arithmetic."""

from pyspark.sql import functions as F

from ..functions import col, concat, divide, lit
from ..operators import select
from ..sources import table
from .registry import query


@query("SELECT s_name, s_nationkey FROM supplier")
def select_columns(spark, sf_dir):
    return select(table(spark, sf_dir, "supplier"), "s_name", "s_nationkey")


@query("SELECT s_name AS supplier, s_nationkey AS nation FROM supplier")
def select_alias(spark, sf_dir):
    return select(table(spark, sf_dir, "supplier"), col("s_name").alias("supplier"), col("s_nationkey").alias("nation"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS plus, l_extendedprice - l_discount AS minus, l_extendedprice * l_quantity AS times, l_extendedprice / l_quantity AS ratio FROM lineitem")
def select_arithmetic(spark, sf_dir):
    price, quantity = col("l_extendedprice"), col("l_quantity")
    return select(
        table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", (price + col("l_tax")).alias("plus"), (price - col("l_discount")).alias("minus"),
        (price * quantity).alias("times"), (price / quantity).alias("ratio"),
    )


@query("SELECT p_partkey, p_size / nullif(p_size - 10, 0) AS ratio FROM part")
def select_safe_division(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), "p_partkey", divide(col("p_size"), col("p_size") - 10).alias("ratio"))


@query("SELECT r_name, 7 AS seven, CAST(2.5 AS DOUBLE) AS half, 'x' AS letter, TRUE AS yes FROM region")
def select_literal(spark, sf_dir):
    return select(table(spark, sf_dir, "region"), "r_name", lit(7).alias("seven"), lit(2.5).alias("half"), lit("x").alias("letter"), lit(True).alias("yes"))


@query("SELECT c_custkey, -c_acctbal AS owed, -c_nationkey AS below FROM customer")
def select_unary_minus(spark, sf_dir):
    return select(table(spark, sf_dir, "customer"), "c_custkey", (-col("c_acctbal")).alias("owed"), (-col("c_nationkey")).alias("below"))


@query("SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR) AS label FROM nation")
def select_string_concat(spark, sf_dir):
    return select(table(spark, sf_dir, "nation"), "n_nationkey", concat(col("n_name"), lit("/"), col("n_regionkey").cast("string")).alias("label"))


@query("SELECT r_regionkey, repeat(r_name, 2) AS twice FROM region")
def select_string_repeat(spark, sf_dir):
    return select(table(spark, sf_dir, "region"), "r_regionkey", F.repeat("r_name", 2).alias("twice"))


@query("SELECT p_partkey, p_size + nullif(p_size, 10) AS sum_or_null, 100 - p_size AS rest FROM part")
def select_null_propagation(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), "p_partkey", (col("p_size") + F.nullif("p_size", lit(10))).alias("sum_or_null"), (lit(100) - col("p_size")).alias("rest"))
