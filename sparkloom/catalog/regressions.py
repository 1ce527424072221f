"""Queries whose answer is easily got wrong."""

from pyspark.sql import functions as F

from ..functions import col, lit
from ..operators import join, select, where
from ..sources import table
from .registry import query
from .sorts import ranked


@query("SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_size + 1 > 45")
def reg_alias_shadow_filter(spark, sf_dir):
    """A filter on an alias that hides an input column must see the alias."""
    return where(select(table(spark, sf_dir, "part"), "p_partkey", (col("p_size") + 1).alias("p_size")), col("p_size") > 45)


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 10 AND p_size * 2 > p_retailprice / 40)")
def reg_not_and_pushdown(spark, sf_dir):
    """Only half of the conjunction can be pushed; under NOT neither may be pushed alone."""
    return select(where(table(spark, sf_dir, "part"), ~((col("p_size") > 10) & (col("p_size") * 2 > col("p_retailprice") / 40))), "p_partkey", "p_size")


@query("SELECT p_partkey, size FROM (SELECT p_partkey, nullif(p_size, 10) AS size FROM part) WHERE size <> 5")
def reg_ne_nulls(spark, sf_dir):
    """Null differs from nothing, whatever the source."""
    return where(select(table(spark, sf_dir, "part"), "p_partkey", F.nullif("p_size", lit(10)).alias("size")), col("size") != 5)


@query("SELECT p_partkey, size, row_number() OVER (ORDER BY size DESC NULLS LAST, p_partkey DESC) AS place FROM (SELECT p_partkey, nullif(p_size, 10) AS size FROM part)")
def reg_sort_null_numeric(spark, sf_dir):
    """Null keys in a range-partitioned descending order."""
    return ranked(select(table(spark, sf_dir, "part"), "p_partkey", F.nullif("p_size", lit(10)).alias("size")), "size", "p_partkey", ascending=False)


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON CAST(c_nationkey AS BIGINT) = n_nationkey")
def reg_numeric_type_keys(spark, sf_dir):
    """Equal numbers of different types match, however the join is carried out."""
    customers = select(table(spark, sf_dir, "customer"), "c_custkey", col("c_nationkey").cast("bigint").alias("n_nationkey"))
    return select(join(customers, table(spark, sf_dir, "nation"), "n_nationkey", strategy="shuffle_hash"), "c_custkey", "n_name")
