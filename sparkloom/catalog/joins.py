"""Inner equi-joins."""

from pyspark.sql import functions as F

from ..functions import col, lit
from ..operators import group, join, select, where
from ..sources import table
from .registry import query


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")


def _order_lines(spark, sf_dir):
    lines = select(table(spark, sf_dir, "lineitem"), col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return select(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus"), lines


NATIONS_SQL = "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
LINES_SQL = "SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(NATIONS_SQL)
def join_inner_single(spark, sf_dir):
    return join(table(spark, sf_dir, "nation"), _regions(spark, sf_dir), "n_regionkey")


@query("SELECT a.l_partkey, a.l_suppkey, a.l_orderkey, b.least FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, min(l_orderkey) AS least FROM lineitem GROUP BY l_partkey, l_suppkey) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_multi_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    least = group(lines, ["l_partkey", "l_suppkey"], F.min("l_orderkey").alias("least"))
    return join(select(lines, "l_partkey", "l_suppkey", "l_orderkey"), least, ["l_partkey", "l_suppkey"])


@query(NATIONS_SQL)
def join_broadcast(spark, sf_dir):
    return join(table(spark, sf_dir, "nation"), _regions(spark, sf_dir), "n_regionkey", strategy="broadcast")


@query(LINES_SQL)
def join_shuffle_hash(spark, sf_dir):
    orders, lines = _order_lines(spark, sf_dir)
    return join(orders, lines, "o_orderkey", strategy="shuffle_hash")


@query(LINES_SQL)
def join_sort_merge(spark, sf_dir):
    orders, lines = _order_lines(spark, sf_dir)
    return join(orders, lines, "o_orderkey", strategy="sort_merge")


@query(LINES_SQL)
def join_fanout(spark, sf_dir):
    orders, lines = _order_lines(spark, sf_dir)
    return join(orders, lines, "o_orderkey")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey + 100")
def join_no_match(spark, sf_dir):
    far = table(spark, sf_dir, "region").select((col("r_regionkey") + 100).alias("n_regionkey"), "r_name")
    return join(table(spark, sf_dir, "nation"), far, "n_regionkey")


NULL_KEYS = "SELECT a.n_nationkey, a.k, b.r_name FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 2) AS k, r_name FROM region) b ON a.k {} b.k"


def _null_keys(spark, sf_dir):
    left = select(table(spark, sf_dir, "nation"), "n_nationkey", F.nullif("n_regionkey", lit(2)).alias("k"))
    return left, select(table(spark, sf_dir, "region"), F.nullif("r_regionkey", lit(2)).alias("k"), "r_name")


@query(NULL_KEYS.format("="))
def join_null_keys_ansi(spark, sf_dir):
    return join(*_null_keys(spark, sf_dir), "k")


@query(NULL_KEYS.format("IS NOT DISTINCT FROM"))
def join_null_safe(spark, sf_dir):
    return join(*_null_keys(spark, sf_dir), "k", null_safe=True)


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain_three(spark, sf_dir):
    customers = select(table(spark, sf_dir, "customer"), "c_custkey", "c_name", col("c_nationkey").alias("n_nationkey"))
    nations = join(table(spark, sf_dir, "nation"), _regions(spark, sf_dir), "n_regionkey")
    return select(join(customers, nations, "n_nationkey"), "c_custkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48 AND o_orderstatus = 'F' AND o_orderkey < 3000")
def join_filter_pushdown(spark, sf_dir):
    orders, lines = _order_lines(spark, sf_dir)
    return where(join(orders, lines, "o_orderkey"), (col("l_quantity") > 48) & (col("o_orderstatus") == "F") & (col("o_orderkey") < 3000))


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_then_aggregate(spark, sf_dir):
    return group(join(table(spark, sf_dir, "nation"), _regions(spark, sf_dir), "n_regionkey"), ["r_name"], F.count("*").alias("nations"))


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name")
def join_self_renamed(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    others = select(nations, "n_regionkey", col("n_name").alias("neighbour"))
    return where(join(nations, others, "n_regionkey"), col("n_name") < col("neighbour"))
