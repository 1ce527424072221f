"""Filters: one for each comparison and connective."""

from pyspark.sql import functions as F

from ..functions import col, lit, null_safe_eq, null_safe_ne
from ..operators import select, where
from ..sources import table
from .registry import query


def _parts(spark, sf_dir, condition):
    return select(where(table(spark, sf_dir, "part"), condition), "p_partkey", "p_brand", "p_size")


def _sql(condition):
    return f"SELECT p_partkey, p_brand, p_size FROM part WHERE {condition}"


size, brand = "p_size", "p_brand"


@query(_sql("p_size > 40"))
def filter_gt(spark, sf_dir):
    return _parts(spark, sf_dir, col(size) > 40)


@query(_sql("p_size >= 40"))
def filter_ge(spark, sf_dir):
    return _parts(spark, sf_dir, col(size) >= 40)


@query(_sql("p_size < 5"))
def filter_lt(spark, sf_dir):
    return _parts(spark, sf_dir, col(size) < 5)


@query(_sql("p_size <= 5"))
def filter_le(spark, sf_dir):
    return _parts(spark, sf_dir, col(size) <= 5)


@query(_sql("p_brand = 'Brand#11'"))
def filter_eq(spark, sf_dir):
    return _parts(spark, sf_dir, col(brand) == "Brand#11")


@query(_sql("p_brand <> 'Brand#11'"))
def filter_ne(spark, sf_dir):
    return _parts(spark, sf_dir, col(brand) != "Brand#11")


@query(_sql("p_brand = 'Brand#11' AND p_size > 20"))
def filter_and(spark, sf_dir):
    return _parts(spark, sf_dir, (col(brand) == "Brand#11") & (col(size) > 20))


@query(_sql("p_brand = 'Brand#11' OR p_size > 45"))
def filter_or(spark, sf_dir):
    return _parts(spark, sf_dir, (col(brand) == "Brand#11") | (col(size) > 45))


@query(_sql("NOT (p_size > 5)"))
def filter_not(spark, sf_dir):
    return _parts(spark, sf_dir, ~(col(size) > 5))


@query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) IS NULL")
def filter_is_null(spark, sf_dir):
    held = select(table(spark, sf_dir, "part"), "p_partkey", F.nullif(size, lit(10)).alias("size"))
    return where(held, col("size").isNull())


@query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) IS NOT NULL")
def filter_is_not_null(spark, sf_dir):
    held = select(table(spark, sf_dir, "part"), "p_partkey", F.nullif(size, lit(10)).alias("size"))
    return where(held, col("size").isNotNull())


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount")
def filter_col_to_col(spark, sf_dir):
    return select(where(table(spark, sf_dir, "lineitem"), col("l_tax") > col("l_discount")), "l_orderkey", "l_linenumber")


@query(_sql("p_size * 2 - 10 > p_size + 25"))
def filter_arithmetic(spark, sf_dir):
    return _parts(spark, sf_dir, col(size) * 2 - 10 > col(size) + 25)


@query(_sql("p_brand = 'Brand#11' OR p_brand = 'Brand#12' AND NOT p_size > 20"))
def filter_precedence(spark, sf_dir):
    return _parts(spark, sf_dir, (col(brand) == "Brand#11") | ((col(brand) == "Brand#12") & ~(col(size) > 20)))


@query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) IS NOT DISTINCT FROM nullif(p_size, p_size)")
def filter_null_safe_eq(spark, sf_dir):
    held = select(table(spark, sf_dir, "part"), "p_partkey", F.nullif(size, lit(10)).alias("size"))
    return where(held, null_safe_eq(col("size"), lit(None).cast("int")))


@query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) IS DISTINCT FROM 5")
def filter_null_safe_ne(spark, sf_dir):
    held = select(table(spark, sf_dir, "part"), "p_partkey", F.nullif(size, lit(10)).alias("size"))
    return where(held, null_safe_ne(col("size"), lit(5)))


@query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) > 5 OR nullif(p_brand, 'Brand#11') = 'Brand#12'")
def filter_three_valued(spark, sf_dir):
    held = select(table(spark, sf_dir, "part"), "p_partkey", F.nullif(size, lit(10)).alias("size"), F.nullif(brand, lit("Brand#11")).alias("brand"))
    return select(where(held, (col("size") > 5) | (col("brand") == "Brand#12")), "p_partkey", "size")


@query(_sql("p_size > 10 AND p_size < 30 AND p_brand <> 'Brand#11'"))
def filter_chained(spark, sf_dir):
    return where(where(_parts(spark, sf_dir, col(size) > 10), col(size) < 30), col(brand) != "Brand#11")
