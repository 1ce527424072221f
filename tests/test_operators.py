"""Operators against plain Python, their checks, and the plans they lead to."""

import random
import sys

import pytest
from helpers import rows
from pyspark.sql import functions as F

from sparkloom import operators as ops
from sparkloom import plans, sources
from sparkloom.errors import PlanError
from sparkloom.functions import col, divide, lit, null_safe_eq, null_safe_ne
from sparkloom.session import SessionOptions
from sparkloom.sql import SqlContext, parse_sql

VESSELS = [("tern", 4, "Oslo"), ("heron", 52, "Lima"), ("gull", None, "Oslo"), ("skua", 23, None), ("petrel", 23, "Lima"), ("auk", 8, "Oslo"), ("dunlin", 61, "Kobe")]


@pytest.fixture(scope="module")
def vessels(spark):
    return spark.createDataFrame(VESSELS, "name string, age bigint, port string")


def test_select_and_where(vessels):
    assert rows(ops.select(ops.where(vessels, col("age") > 20), "name", (col("age") + 1).alias("next"))) == [("dunlin", 62), ("heron", 53), ("petrel", 24), ("skua", 24)]
    with pytest.raises(ValueError):
        ops.select(vessels)
    with pytest.raises(PlanError):
        ops.select(vessels, "name", col("age").alias("NAME"))


def test_null_forms(vessels):
    assert ops.where(vessels, col("age") != 52).count() == 5
    assert ops.where(vessels, null_safe_ne(col("age"), lit(52))).count() == 6
    assert ops.where(vessels, null_safe_eq(col("age"), lit(None).cast("bigint"))).count() == 1
    assert rows(vessels.limit(1).select(divide(lit(1), lit(0)))) == [(None,)]


def test_group_keeps_null_key(vessels):
    found = rows(ops.group(vessels, ["port"], F.count("*").alias("n"), F.sum("age").alias("s"), F.avg("age").alias("a")))
    wanted = {}
    for _, age, port in VESSELS:
        wanted.setdefault(port, []).append(age)
    known = {k: [x for x in v if x is not None] for k, v in wanted.items()}
    assert found == sorted(((k, len(v), sum(known[k]), sum(known[k]) / len(known[k])) for k, v in wanted.items()), key=repr)
    for call in (lambda: ops.group(vessels, [], F.count("*")), lambda: ops.group(vessels, ["age"]), lambda: ops.aggregate(vessels), lambda: ops.distinct_groups(vessels)):
        with pytest.raises(ValueError):
            call()


def test_global_aggregate_of_nothing_is_one_row(vessels):
    assert rows(ops.aggregate(ops.where(vessels, lit(False)), F.count("*").alias("n"), F.sum("age").alias("s"))) == [(0, None)]
    assert rows(ops.distinct_groups(vessels, "port")) == sorted([("Oslo",), ("Lima",), ("Kobe",), (None,)], key=repr)


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle_hash", "sort_merge"])
def test_join_strategies_agree(spark, strategy):
    random.seed(5)
    left = [(random.choice([None, *range(12)]), i) for i in range(60)]
    right = [(random.choice([None, *range(15)]), f"r{i}") for i in range(40)]
    a, b = spark.createDataFrame(left, "id bigint, x bigint"), spark.createDataFrame(right, "id bigint, y string")
    joined = ops.join(a, b, "id", strategy=strategy)
    assert joined.columns == ["id", "x", "y"]
    assert rows(joined) == sorted(((k, x, y) for k, x in left for j, y in right if k == j and k is not None), key=repr)
    safe = ops.join(a, b, ["id"], strategy=strategy, null_safe=True)
    assert rows(safe) == sorted(((k, x, y) for k, x in left for j, y in right if k == j), key=repr)
    wanted = {"broadcast": "BroadcastHashJoin", "shuffle_hash": "ShuffledHashJoin", "sort_merge": "SortMergeJoin"}
    if strategy in wanted:
        assert set(plans.join_strategies(joined)) == {wanted[strategy]} == set(plans.join_strategies(safe))


def test_join_checks(vessels):
    for on, error in (([], ValueError), (["city"], PlanError), (["name"], PlanError)):
        with pytest.raises(error):
            ops.join(vessels, vessels, on)
    with pytest.raises(ValueError):
        ops.join(vessels, vessels, "name", strategy="guess")


def test_column_order_of_join(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "x int, k int, y int"), spark.createDataFrame([(9, 2)], "z int, k int")
    assert ops.join(a, b, "k").columns == ["x", "k", "y", "z"]


def test_sort_puts_nulls_last_both_ways(spark):
    random.seed(7)
    data = [(random.choice([None, *range(9)]), random.choice([None, *range(9)])) for _ in range(200)]
    df = spark.createDataFrame(data, "a bigint, b bigint").repartition(5)
    last = lambda v, up: (v is None, 0 if v is None else v if up else -v)
    for up_a in (True, False):
        for up_b in (True, False):
            found = [tuple(r) for r in ops.sort(df, "a", "b", ascending=[up_a, up_b]).collect()]
            assert found == sorted(data, key=lambda r: (last(r[0], up_a), last(r[1], up_b)))
    assert [r[0] for r in ops.head(df, 3, "a").collect()] == sorted(x for x, _ in data if x is not None)[:3]
    with pytest.raises(ValueError):
        ops.sort(df)
    with pytest.raises(ValueError):
        ops.sort(df, "a", ascending=[True, False])


def test_partitioning_keeps_rows(spark):
    df = spark.range(100).withColumn("k", col("id") % 7)
    for moved, n in ((ops.repartition(df, 3), 3), (ops.repartition_by_hash(df, 4, "k"), 4), (ops.repartition_by_range(df, 2, "k"), 2)):
        assert moved.rdd.getNumPartitions() == n and rows(moved) == rows(df)
    where = ops.repartition_by_hash(df, 4, "k").withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("p").alias("n"))
    assert {r["n"] for r in where.collect()} == {1}
    with pytest.raises(ValueError):
        ops.repartition(df, 0)


def test_statistics(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("b", 10)], "s string, n bigint")
    assert rows(ops.table_statistics(df)) == [("n", 3, 1, 2, "3", "10"), ("s", 3, 0, 2, "a", "b")]
    assert rows(ops.table_statistics(df, ["n"], approximate=0.05))[0][:4] == ("n", 3, 1, 2)
    assert rows(ops.table_statistics(df.limit(0), ["n"])) == [("n", 0, 0, 0, None, None)]


def test_checkpoint_cuts_the_plan(spark, vessels, tmp_path):
    kept = ops.checkpoint(ops.where(vessels, col("age") > 18), str(tmp_path / "c"))
    assert rows(kept) == rows(ops.where(vessels, col("age") > 18)) and kept.schema.names == vessels.schema.names
    assert "Filter (" not in plans.physical(kept) and "FileScan parquet" in plans.physical(kept)


def test_metrics(vessels):
    result, metrics = ops.measured(ops.group(vessels, ["port"], F.count("*").alias("n")), lambda df: df.collect())
    assert len(result) == metrics.rows == 4 and metrics.seconds > 0
    assert "4 rows" in metrics.summary()


def test_csv(spark, tmp_path):
    data = [(1, "a,b", None), (2, 'say "hi"', 2.5), (3, None, -1.0)]
    df = spark.createDataFrame(data, "id bigint, label string, x double")
    sources.write_csv(df, str(tmp_path / "t"))
    assert rows(sources.read_csv(spark, str(tmp_path / "t"), "id bigint, label string, x double")) == rows(df)
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed|MALFORMED"):
        sources.read_csv(spark, str(tmp_path / "ragged.csv"), "a int, b int").collect()
    (tmp_path / "lines.csv").write_text('id,note\n1,"two\nlines"\n2,one')
    assert rows(sources.read_csv(spark, str(tmp_path / "lines.csv"), "id int, note string", multiline=True)) == [(1, "two\nlines"), (2, "one")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_csv(spark, str(tmp_path / "none.csv"))


def test_memory(spark):
    df = sources.from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2}], partitions=9)
    assert rows(df) == [(1, "x"), (2, None)] and df.rdd.getNumPartitions() <= 2
    assert sources.from_rows(spark, [], "a int").count() == 0
    with pytest.raises(ValueError):
        sources.from_rows(spark, [])
    assert sources.collect(df)[0] == {"a": 1, "b": "x"}


def test_parquet_pushdown_and_pruning(spark, tmp_path):
    sources.write_parquet(spark.range(1000).selectExpr("id AS a", "id * 2 AS b", "cast(id AS string) AS c"), str(tmp_path / "p"))
    df = ops.select(ops.where(sources.read_parquet(spark, str(tmp_path / "p")), (col("a") > 990) & (col("b") != 1990)), "a")
    assert rows(df) == [(x,) for x in (991, 992, 993, 994, 996, 997, 998, 999)]
    assert any("GreaterThan(a,990)" in f for f in plans.pushed_filters(df))
    assert set(plans.read_columns(df)) == {"a", "b"}
    grouped = ops.where(ops.group(sources.read_parquet(spark, str(tmp_path / "p")), ["a"], F.count("*").alias("n")), col("a") == 5)
    assert any("EqualTo(a,5)" in f for f in plans.pushed_filters(grouped))


def test_sql_equals_dataframe(spark, vessels):
    context = SqlContext(spark)
    context.register("vessels", vessels)
    said = context.query("SELECT port, COUNT(*) AS n FROM vessels WHERE age > 16 GROUP BY port HAVING COUNT(*) > 1 ORDER BY port")
    made = ops.sort(ops.where(ops.group(ops.where(vessels, col("age") > 16), ["port"], F.count("*").alias("n")), col("n") > 1), "port")
    assert rows(said) == rows(made) == [("Lima", 2)]
    context.register("vessels", vessels.limit(0))
    assert context.query("SELECT * FROM vessels").count() == 0 and said.count() == 1
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        context.query("SELEC 1")
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        context.query("SELECT nothing FROM vessels")
    with pytest.raises(ValueError):
        context.register("no name", vessels)


def test_explain_runs_nothing(spark, vessels):
    text = plans.explain(ops.sort(vessels, "age"))
    assert "Sort" in text and "Physical" not in text
    assert "Physical" in plans.explain(vessels, optimized=True)


def test_estimated_bytes(spark, tmp_path):
    sources.write_parquet(spark.range(5000).selectExpr("id", "cast(id AS string) AS s"), str(tmp_path / "t"))
    df = sources.read_parquet(spark, str(tmp_path / "t"))
    assert 0 < plans.estimated_bytes(ops.select(df, "id")) < plans.estimated_bytes(df)


def test_session_options():
    made = SessionOptions(master="local[2]", task_retries=2)
    assert made.master_url() == "local[2,3]" and made.settings()["spark.task.maxFailures"] == "3"
    assert SessionOptions(master="spark://host:7077").master_url() == "spark://host:7077"
    with pytest.raises(ValueError):
        SessionOptions(shuffle_partitions=0).settings()


def test_streaming_counts(spark, tmp_path):
    from sparkloom.streaming import tumbling_counts

    sources.write_parquet(spark.sql("SELECT timestamp_seconds(id * 60) AS ts, cast(id % 2 AS string) AS k FROM range(120)"), str(tmp_path / "in"))
    batch = tumbling_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "k", "1 hour", "5 minutes")
    stream = tumbling_counts(spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in")), "ts", "k", "1 hour", "5 minutes")
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert rows(spark.table("counts")) == rows(batch) and batch.count() == 4


def test_custom_aggregate(spark):
    class Longest(ops.AggregateFunction):
        result_type = "string"

        def initialize(self):
            return ""

        def update(self, state, value):
            return self.merge(state, value or "")

        def merge(self, left, right):
            return max(left, right, key=lambda x: (len(x), x))

        def finalize(self, state):
            return state or None

    data = [(k % 3 if k % 7 else None, "x" * (k % 11) + str(k)) for k in range(200)] + [(9, None)]
    found = rows(ops.custom_aggregate(spark.createDataFrame(data, "k int, s string").repartition(6), ["k"], "s", Longest(), "longest"))
    wanted = {}
    for k, s in data:
        wanted[k] = max(wanted.get(k, ""), s or "", key=lambda x: (len(x), x))
    assert found == sorted(((k, v or None) for k, v in wanted.items()), key=repr)
    with pytest.raises(ValueError):
        ops.custom_aggregate(spark.range(1), [], "id", Longest(), "x")


def test_show(vessels):
    text = sources.show(ops.sort(vessels, "name"), 2)
    assert "auk" in text and "dunlin" in text and "gull" not in text


def test_udfs(vessels):
    from sparkloom.functions import udf

    assert ("TERN",) in rows(vessels.select(udf(lambda s: s.upper(), "string")("name")))


def test_sql_contexts_keep_their_names_to_themselves(spark):
    one, two = SqlContext(spark), SqlContext(spark)
    spark.range(5).createOrReplaceTempView("shared")
    one.register("shared", spark.range(2))
    two.register("shared", spark.range(3))
    first, second = one.query("SELECT * FROM shared"), two.query("SELECT * FROM shared")
    assert (first.count(), second.count(), spark.table("shared").count()) == (2, 3, 5)
    one.register("mine", spark.range(1))
    assert one.query("SELECT * FROM mine").count() == 1
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        two.query("SELECT * FROM mine")
    spark.catalog.dropTempView("shared")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        spark.table("mine")


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("SELECT name FROM vessels WHERE age >", "(?s)PARSE_SYNTAX_ERROR.*line 1, pos 36"),
        ("SELECT name\nFROM vessels\nWHERE (age > 1", "(?s)PARSE_SYNTAX_ERROR.*line 3, pos"),
        ("SELECT name FROM vessels nonsense words", "PARSE_SYNTAX_ERROR"),
        ("SELECT * FROM boats", "TABLE_OR_VIEW_NOT_FOUND"),
        ("SELECT no_such(age) FROM vessels", "UNRESOLVED_ROUTINE"),
        ("SELECT name, COUNT(*) FROM vessels GROUP BY port", "MISSING_AGGREGATION"),
        ("SELECT name, COUNT(*) FROM vessels", "MISSING_GROUP_BY"),
        ("SELECT name FROM vessels WHERE COUNT(*) > 1", "INVALID_WHERE_CONDITION"),
        ("SELECT port FROM vessels GROUP BY port HAVING age > 1", "MISSING_AGGREGATION|UNRESOLVED_COLUMN"),
        ("SELECT port + FROM vessels", "PARSE_SYNTAX_ERROR|UNRESOLVED_COLUMN"),
    ],
)
def test_sql_errors(vessels, text, error):
    with pytest.raises(Exception, match=error):
        parse_sql(text, {"vessels": vessels})


def test_parse_sql_needs_no_session(vessels):
    out = parse_sql("SELECT port, MAX(age) AS oldest FROM vessels WHERE age IS NOT NULL GROUP BY port HAVING MAX(age) > 8", {"Vessels": vessels})
    assert rows(out) == [("Kobe", 61), ("Lima", 52), (None, 23)]
    assert "Aggregate" in plans.explain(out)
    with pytest.raises(ValueError):
        parse_sql("SELECT 1", {})


def test_plan_errors(vessels):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        ops.select(vessels, "draught")
    with pytest.raises(Exception, match="INVALID_WHERE_CONDITION|MISSING_GROUP_BY|GROUP_EXPRESSION"):
        ops.where(vessels, F.sum("age") > 1)
    with pytest.raises(Exception, match="DATATYPE_MISMATCH"):
        ops.where(vessels, col("age"))
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        ops.sort(vessels, "draught")


def test_csv_sample(spark, tmp_path):
    sources.write_csv(spark.range(2000).selectExpr("id", "id / 2 AS half"), str(tmp_path / "t"))
    assert dict(sources.read_csv(spark, str(tmp_path / "t"), sample=0.2).dtypes) == {"id": "int", "half": "double"}


def test_custom_aggregate_bounds_its_states(spark, monkeypatch):
    from sparkloom.operators import custom_aggregate as module

    class Total(ops.AggregateFunction):
        result_type = "bigint"

        def initialize(self):
            return 0

        def update(self, state, value):
            return state + (value or 0)

        def merge(self, left, right):
            return left + right

        def finalize(self, state):
            return state

    monkeypatch.setattr(sys.modules[module.__module__], "MAX_STATES", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        data = [(float("nan") if k % 5 == 0 else None if k % 7 == 0 else float(k % 90), k) for k in range(600)]
        df = spark.createDataFrame(data, "k double, v bigint").repartition(3)
        found = rows(ops.custom_aggregate(df, ["k"], "v", Total(), "total"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {}
    for k, v in data:
        wanted[repr(k)] = wanted.get(repr(k), 0) + v
    assert sorted((repr(k), v) for k, v in found) == sorted(wanted.items())
