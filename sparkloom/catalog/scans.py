"""Sources and sinks: what is written must be what is read."""

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import aggregate, checkpoint, group, select, where
from ..session import scratch_path
from ..sources import from_rows, read_csv, read_custom, read_parquet, table, write_csv, write_parquet
from .registry import query

PEOPLE = [
    {"name": "ada", "age": 36, "country": "UK"},
    {"name": "lin", "age": 17, "country": "CN"},
    {"name": "sol", "age": None, "country": "MX"},
    {"name": "kim", "age": 52, "country": None},
]
PEOPLE_SQL = "SELECT * FROM (VALUES ('ada', 36::BIGINT, 'UK'), ('lin', 17, 'CN'), ('sol', NULL, 'MX'), ('kim', 52, NULL)) AS t(name, age, country)"


@query("SELECT * FROM region")
def scan_all_region(spark, sf_dir):
    return table(spark, sf_dir, "region")


@query(PEOPLE_SQL)
def scan_memory_rows(spark, sf_dir):
    return from_rows(spark, PEOPLE, "name string, age bigint, country string")


@query(f"SELECT name, age FROM ({PEOPLE_SQL}) WHERE age > 20")
def scan_memory_inferred(spark, sf_dir):
    return select(where(from_rows(spark, PEOPLE, partitions=2), "age > 20"), "name", "age")


@query("SELECT * FROM nation")
def scan_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "nation"), path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def scan_csv_inferred(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "nation"), path)
    return where(read_csv(spark, path), "n_regionkey = 1")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_csv_explicit_schema(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return read_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("SELECT p_partkey, nullif(p_size, 10) AS p_size, nullif(p_brand, 'Brand#11') AS p_brand FROM part")
def scan_csv_empty_as_null(spark, sf_dir):
    path = scratch_path(spark, "csv")
    part = table(spark, sf_dir, "part")
    write_csv(part.select("p_partkey", F.nullif("p_size", F.lit(10)).alias("p_size"), F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand")), path)
    return read_csv(spark, path, "p_partkey bigint, p_size int, p_brand string")


@query("SELECT r_regionkey, r_name || ', the ' || r_name AS label FROM region")
def scan_csv_quoted_commas(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit(", the "), "r_name").alias("label")), path)
    return read_csv(spark, path, "r_regionkey int, label string")


@query("SELECT r_regionkey, r_name || chr(10) || r_name AS note FROM region")
def scan_csv_multiline(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit("\n"), "r_name").alias("note")), path)
    return read_csv(spark, path, "r_regionkey int, note string", multiline=True)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_parquet_directory(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(5), path)
    return read_parquet(spark, path)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_parquet_pushdown(spark, sf_dir):
    rows = where(table(spark, sf_dir, "lineitem"), (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return select(rows, "l_orderkey", "l_quantity")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def scan_column_pruned(spark, sf_dir):
    return select(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def write_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    write_parquet(table(spark, sf_dir, "nation"), path)
    return read_parquet(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def write_parquet_partitions(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    write_parquet(table(spark, sf_dir, "nation"), path, partition_by=["n_regionkey"])
    return where(read_parquet(spark, path), F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_regionkey, r_name FROM region")
def write_parquet_overwrites(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    write_parquet(table(spark, sf_dir, "nation").repartition(7), path)
    write_parquet(table(spark, sf_dir, "region").coalesce(1), path)
    return read_parquet(spark, path)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0")
def checkpoint_roundtrip(spark, sf_dir):
    return checkpoint(select(where(table(spark, sf_dir, "customer"), "c_acctbal > 0"), "c_custkey", "c_nationkey"))


@query("SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def checkpoint_then_aggregate(spark, sf_dir):
    kept = checkpoint(where(table(spark, sf_dir, "customer"), "c_acctbal > 0"), scratch_path(spark, "named"))
    return group(kept, ["c_mktsegment"], F.count("*").alias("customers"))


@query("SELECT count(*) AS orders, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders")
def scan_timestamps(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "orders"), F.count("*").alias("orders"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


class Squares(DataSource):
    """Numbers below ``limit`` and their squares, in four partitions."""

    @classmethod
    def name(cls):
        return "sparkloom_squares"

    def schema(self):
        return "n long, square long"

    def reader(self, schema):
        limit = int(self.options.get("limit", "10"))

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(k) for k in range(4)]

            def read(self, partition):
                return ((n, n * n) for n in range(partition.value, limit, 4))

        return Reader()


@query("SELECT range AS n, range * range AS square FROM range(100) WHERE range % 3 = 0")
def scan_custom_source(spark, sf_dir):
    return where(read_custom(spark, Squares, limit=100), F.col("n") % 3 == 0)
