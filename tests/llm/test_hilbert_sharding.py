import itertools
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.hilbert_sharding import OP2_SQL, Dimension, hilbert_index, hilbert_shards, hilbert_table, op2_hilbert_sharding, write_shards


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(dims)))
    found = df.withColumn("h", hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).collect()
    at = {r["h"]: tuple(r)[:-1] for r in found}
    assert sorted(at) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(len(cells) - 1))
    assert len(hilbert_table(dims)) == dims * (1 << dims) ** 2


def test_runs_are_even_gapless_and_complete(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), None if k % 9 == 0 else rng.randrange(1000)) for k in range(503)] + [(1, "a", 5)] * 200
    df = spark.createDataFrame(rows, "id long, source string, n long").repartition(4)
    out = hilbert_shards(df, [Dimension("source"), Dimension("n", log=True)], 40, ["id", "source", "n"]).collect()
    assert Counter((r["id"], r["source"], r["n"]) for r in out) == Counter(rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(size))
    order = [r["curve"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    spans = {s: {r["source"] for r in out if r["shard"] == s} for s in sizes}
    assert sum(len(v) for v in spans.values()) < 2 * len(spans)  # most shards hold one source: files can be skipped


def test_edges(spark, tmp_path):
    dims = [Dimension("a"), Dimension("b")]
    few = spark.createDataFrame([(1, 2.0), (None, float("nan"))], "a long, b double")
    assert sorted(r["shard"] for r in hilbert_shards(few, dims, 5, ["a", "b"]).collect()) == [0, 2]
    assert hilbert_shards(few.limit(0), dims, 5, ["a"]).count() == 0
    with pytest.raises(ValueError, match="in use"):
        hilbert_shards(few.withColumn("slot", F.lit(1)), dims, 5, ["a"])
    with pytest.raises(ValueError):
        hilbert_shards(few, dims, 0, ["a"])
    keyed = spark.range(50).selectExpr("id", "id % 7 AS a", "id % 5 AS b")
    write_shards(keyed, hilbert_shards(keyed, dims, 4, ["id"]), "id", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_texts_that_begin_alike_have_cells_of_their_own(spark):
    """Sources with a common start are told apart, so a filter on one reads its own shards and few others."""
    rng = random.Random(5)
    names = [f"common_crawl_{k}" for k in range(8)] + ["common_pile"]
    rows = [(k, names[k % 9] if k % 10 else None, rng.randrange(1000)) for k in range(1800)]
    df = spark.createDataFrame(rows, "id long, source string, n long").repartition(4)
    out = hilbert_shards(df, [Dimension("source"), Dimension("n")], 90, ["id"]).collect()
    assert Counter((r["id"], r["source"], r["n"]) for r in out) == Counter(rows)
    spans = {s: {r["shard"] for r in out if r["source"] == s} for s in names}
    assert max(len(v) for v in spans.values()) <= 30
    many = spark.range(1000).selectExpr("id", "concat('common_crawl_', lpad(id, 6, '0')) AS source", "0 AS n")
    cells = Counter(r["curve"] for r in hilbert_shards(many, [Dimension("source"), Dimension("n")], 10, ["id"], bits=4).collect())
    assert len(cells) == 16 and max(cells.values()) - min(cells.values()) <= 1


def test_query_against_a_plain_version(spark, docs, tmp_path):
    """Sizes, checksums, cells, curve, order, shards and slots of the query, made again without Spark."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = op2_hilbert_sharding(spark, str(tmp_path)).collect()
    rows = docs.collect()

    def text_cells(name):
        values = sorted({r[name] for r in rows if r[name] is not None}, key=str.encode)
        return {None: 0} | {v: (k << 8) // len(values) for k, v in enumerate(values)}

    sources, langs = text_cells("source"), text_cells("lang")
    sizes = [math.log2(r["n_chars"] + 1) for r in rows if r["n_chars"] is not None]
    low, high = min(sizes), max(sizes)
    table = hilbert_table(3)

    def curve(r):
        long = 0 if r["n_chars"] is None else min(255, int((math.log2(r["n_chars"] + 1) - low) * (256 / (high - low))))
        cells, state, index = (sources[r["source"]], langs[r["lang"]], long), 0, 0
        for bit in range(7, -1, -1):
            entry = table[state * 8 + sum(((c >> bit) & 1) << k for k, c in enumerate(cells))]
            state, index = entry >> 3, index * 8 + (entry & 7)
        return index

    text = lambda r: (r["text"] or "").encode()
    order = sorted(rows, key=lambda r: (curve(r), zlib.crc32(text(r)), len(text(r)) + 16, r["doc_id"]))
    wanted, place = [], Counter()
    for k, r in enumerate(order):
        shard = k * 40 // len(order)
        wanted.append((r["doc_id"], len(text(r)) + 16, zlib.crc32(text(r)), "rows", shard, place[shard], None))
        place[shard] += 1
    assert sorted(tuple(r)[:7] for r in out) == sorted(wanted)


def test_query_equals_its_sql(spark, docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out, said = op2_hilbert_sharding(spark, str(tmp_path)), con.sql(OP2_SQL)
    place = [said.columns.index(c) for c in out.columns]
    assert sorted((tuple(r[i] for i in place) for r in said.fetchall()), key=repr) == sorted((tuple(r) for r in out.collect()), key=repr)


def test_columns_of_any_name(spark):
    df = spark.range(60).selectExpr("id", "id % 7 AS a", "id % 5 AS b", "concat('x', id) AS `__at`", "id AS `__rank`", "id AS column_0", "id AS `__c0`")
    out = hilbert_shards(df, [Dimension("a"), Dimension("b")], 4, ["id"])
    assert out.columns == [*df.columns, "curve", "shard", "slot"]
    assert all(r["__at"] == f"x{r['id']}" and r["__rank"] == r["column_0"] == r["__c0"] == r["id"] for r in out.collect())
