"""Order, made visible as a rank column: rows are compared without their order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lit
from ..operators import checkpoint, group, head, select, sort
from ..sources import table
from .registry import query


def ranked(df: DataFrame, *columns: str, ascending=True) -> DataFrame:
    """The sorted rows with their place. The place comes from each sorted partition's row numbers and the rows before it,
    so that no single task sees all rows. The numbered rows are written first: read twice from a plan, they might be cut into
    other partitions the second time."""
    whole = sort(df, *columns, ascending=ascending).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    placed = checkpoint(whole)
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(before, "part").select("row.*", place.alias("place"))


def _sql(columns: str, source: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS place FROM {source}"


@query(_sql("c_custkey, c_acctbal", "customer", "c_acctbal, c_custkey"))
def sort_asc(spark, sf_dir):
    return ranked(select(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query(_sql("c_custkey, c_acctbal", "customer", "c_acctbal DESC, c_custkey DESC"))
def sort_desc(spark, sf_dir):
    return ranked(select(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", ascending=False)


@query(_sql("p_partkey, p_brand, p_size", "part", "p_brand, p_size DESC, p_partkey"))
def sort_multi_mixed(spark, sf_dir):
    return ranked(select(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_size"), "p_brand", "p_size", "p_partkey", ascending=[True, False, True])


@query(_sql("p_partkey, size", "(SELECT p_partkey, nullif(p_size, 10) AS size FROM part)", "size NULLS LAST, p_partkey"))
def sort_nulls_last_asc(spark, sf_dir):
    return ranked(select(table(spark, sf_dir, "part"), "p_partkey", F.nullif("p_size", lit(10)).alias("size")), "size", "p_partkey")


@query(_sql("p_partkey, size", "(SELECT p_partkey, nullif(p_size, 10) AS size FROM part)", "size DESC NULLS LAST, p_partkey"))
def sort_nulls_last_desc(spark, sf_dir):
    return ranked(select(table(spark, sf_dir, "part"), "p_partkey", F.nullif("p_size", lit(10)).alias("size")), "size", "p_partkey", ascending=[False, True])


@query(_sql("n_nationkey, n_name", "nation", "n_name"))
def sort_string_key(spark, sf_dir):
    return ranked(select(table(spark, sf_dir, "nation"), "n_nationkey", "n_name"), "n_name")


@query(_sql("c_nationkey, customers", "(SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey)", "customers DESC, c_nationkey"))
def sort_after_aggregate(spark, sf_dir):
    counted = group(table(spark, sf_dir, "customer"), ["c_nationkey"], F.count("*").alias("customers"))
    return ranked(counted, "customers", "c_nationkey", ascending=[False, True])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_n(spark, sf_dir):
    return head(select(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice"), 20, "o_totalprice", "o_orderkey", ascending=[False, True])
