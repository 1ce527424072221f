"""Larger queries that put the operators together."""

from pyspark.sql import functions as F

from ..functions import col
from ..operators import group, join, select, where
from ..sources import table
from .aggregates import exact
from .registry import query


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS orders, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_net
FROM lineitem WHERE l_discount <= 0.05 GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    lines = where(table(spark, sf_dir, "lineitem"), col("l_discount") <= 0.05)
    net = col("l_extendedprice").cast("decimal(18,2)") * (1 - col("l_discount").cast("decimal(4,2)"))
    return group(lines, ["l_returnflag", "l_linestatus"], F.count("*").alias("orders"), exact("l_quantity").alias("sum_qty"), exact("l_extendedprice").alias("sum_price"), F.sum(net).cast("double").alias("sum_net"))


@query("""
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    net = (col("l_extendedprice").cast("decimal(18,2)") * (1 - col("l_discount").cast("decimal(4,2)"))).alias("net")
    lines = select(table(spark, sf_dir, "lineitem"), col("l_orderkey").alias("o_orderkey"), net)
    by_order = group(lines, ["o_orderkey"], F.sum("net").alias("net"))  # partial sums before the larger join
    orders = select(table(spark, sf_dir, "orders"), "o_orderkey", col("o_custkey").alias("c_custkey"))
    customers = select(table(spark, sf_dir, "customer"), "c_custkey", col("c_nationkey").alias("n_nationkey"))
    nations = select(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    joined = join(join(join(by_order, orders, "o_orderkey"), customers, "c_custkey"), nations, "n_nationkey")
    return group(joined, ["n_name"], F.sum("net").cast("double").alias("revenue"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_seen, max(value) AS most FROM events GROUP BY event_type")
def events_by_type(spark, sf_dir):
    return group(table(spark, sf_dir, "events"), ["event_type"], F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_seen"), F.max("value").alias("most"))


@query("SELECT lang, quality, toxic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality, toxic")
def label_quality_by_lang(spark, sf_dir):
    docs = select(table(spark, sf_dir, "documents"), "doc_id", "lang", "n_chars")
    return group(join(docs, table(spark, sf_dir, "labels"), "doc_id"), ["lang", "quality", "toxic"], F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
