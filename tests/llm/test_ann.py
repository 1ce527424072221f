import random

import numpy as np
import pytest

from sparkloom.llm.ann import Params, build_shards, link_layer, op1_hnsw, search_shards


def brute(rows, query, k):
    """Nearest others of a query by exact distance, ties to the smaller id."""
    own, vector = query
    found = [(float(np.sqrt(((np.array(v) - np.array(vector)) ** 2).sum())), i) for i, v in rows if i != own]
    return sorted(found)[:k]


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 4
    return [(int(k) * 3, (centres[k % 12] + rng.normal(size=dims)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("shard_rows", [400, 5000])
def test_recall(spark, shard_rows):
    rows = vectors(1500) + [(100_000 + k, [1.5] * 16) for k in range(500)]  # one vector a quarter of all rows
    params = Params(shard_rows=shard_rows, block=32)
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    queries = [r for r in rows if r[0] % 50 == 0]
    out = search_shards(build_shards(df, "id", "v", 10, params), df.where("id % 50 = 0"), "id", "v", 10, params).collect()
    hits = 0
    for q in queries:
        mine = sorted(((r["rank"], r["score"], r["vec_id"]) for r in out if r["query_id"] == q[0]))
        assert [m[0] for m in mine] == list(range(1, 11)) and q[0] not in {m[2] for m in mine}
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        wanted = brute(rows, q, 10)
        hits += len({m[2] for m in mine} & {i for _, i in wanted})
        if q[1] == [1.5] * 16:
            assert [(m[1], m[2]) for m in mine] == wanted  # ties of equal vectors go to the smaller ids
    assert hits >= 0.95 * 10 * len(queries)


def test_unusable_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [4.0, 4.0]), (9, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = search_shards(build_shards(df, "id", "v", 3), df, "id", "v", 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(1, 1, 9, 5.0), (9, 1, 1, 5.0)]
    none = df.limit(0)
    assert search_shards(build_shards(none, "id", "v", 3), df, "id", "v", 3).count() == 0
    assert search_shards(build_shards(df, "id", "v", 3), none, "id", "v", 3).count() == 0


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_repeated_rows_take_no_slots(spark, shard_rows):
    """Copies of a row, and vectors of one id at one distance, leave room for the other neighbours."""
    near = [(500, [0.5, 0.0])] * 40 + [(501, [0.5, 0.0]), (502, [0.5, 0.0])]
    around = [(503, [float(np.cos(a)), float(np.sin(a))]) for a in (0, np.pi / 2, np.pi, 3 * np.pi / 2)]
    rows = [(1, [1e-9, 0.0]), *near, *around, *[(600 + i, [2.0 + i, 0.0]) for i in range(12)]]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    query = spark.createDataFrame([(1, [1e-9, 0.0])], df.schema)
    params = Params(shard_rows=shard_rows)
    out = search_shards(build_shards(df, "id", "v", 10, params), query, "id", "v", 10, params).orderBy("rank").collect()
    wanted = sorted({(d, i) for d, i in brute(rows, rows[0], len(rows))})[:10]
    assert [(r["score"], r["vec_id"]) for r in out] == wanted


def test_layers_are_bounded_and_linked():
    rng = np.random.default_rng(1)
    points = np.unique(rng.normal(size=(300, 8)), axis=0)
    table = link_layer(points, 16, 48)
    assert table.shape == (300, 16) and (table < 300).all() and not (table == np.arange(300)[:, None]).any()
    seen, edge = {0}, [0]
    while edge:
        edge = [int(x) for n in edge for x in table[n] if x >= 0 and int(x) not in seen]
        seen |= set(edge)
    assert len(seen) >= 0.99 * 300
    assert link_layer(points[:1], 4, 8).tolist() == [[-1] * 4]


def test_query(spark, tmp_path):
    random.seed(3)
    rows = [(k, v, k % 2) for k, (_, v) in enumerate(vectors(700))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = op1_hnsw(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in out} == set(range(0, 700, 100)) and len(out) == 70


def test_routing_is_measured(spark):
    """Vectors in clumps need few cells; vectors without structure are searched in all, and neither loses neighbours."""
    rng = np.random.default_rng(4)
    loose = [(k, rng.normal(size=24).tolist()) for k in range(2400)]
    clumped = vectors(2400)
    for rows, few in ((clumped, True), (loose, False)):
        df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
        params = Params(shard_rows=200, cells=12)
        index = build_shards(df, "id", "v", 10, params)
        assert index.probes <= 6 if few else index.probes >= 9
        queries = [r for r in rows if r[0] % 40 == 0]
        out = search_shards(index, df.where("id % 40 = 0"), "id", "v", 10, params).collect()
        hits = sum(len({i for _, i in brute(rows, q, 10)} & {r["vec_id"] for r in out if r["query_id"] == q[0]}) for q in queries)
        assert hits >= 0.95 * 10 * len(queries)


def test_cells_of_near_copies_are_cut(spark):
    """A third of all rows around one point: shards stay at their size, all of the cell's are searched."""
    rng = np.random.default_rng(5)
    rows = vectors(1000) + [(50_000 + k, (np.full(16, 30.0) + rng.normal(size=16) * 1e-3).tolist()) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    params = Params(shard_rows=150, cells=6)
    index = build_shards(df, "id", "v", 10, params)
    held = [len(r["ids"]) // 8 // 11 for r in index.shards.collect()]
    assert sum(held) == 2000 and max(held) < 300
    queries = [r for r in rows if r[0] >= 50_000][::50]
    out = search_shards(index, df.where("id >= 50000 and id % 50 = 0"), "id", "v", 10, params).collect()
    hits = sum(len({i for _, i in brute(rows, q, 10)} & {r["vec_id"] for r in out if r["query_id"] == q[0]}) for q in queries)
    assert hits >= 0.95 * 10 * len(queries)


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1.0])
def test_magnitudes(spark, scale):
    """Squares that overflow or vanish, and points far from the origin, lose no neighbour."""
    rng = np.random.default_rng(6)
    away = 1e9 if scale == 1.0 else 0.0
    rows = [(k, ((rng.normal(size=4) + away) * scale).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = search_shards(build_shards(df, "id", "v", 5), df, "id", "v", 5).collect()
    wide = [(i, np.array(v, np.longdouble)) for i, v in rows]
    hits = 0
    for own, v in wide:
        best = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in wide if i != own)[:5]
        mine = sorted((r["score"], r["vec_id"]) for r in out if r["query_id"] == own)
        assert len(mine) == 5 and all(np.isfinite(m[0]) for m in mine)
        hits += len({i for _, i in best} & {i for _, i in mine})
    assert hits >= 0.97 * 5 * 300


def test_query_against_brute_force(spark, tmp_path):
    rows = [(k, v) for k, (_, v) in enumerate(vectors(900))] + [(901, None), (902, [0.0] * 16), (1000, [1.0] * 16), (1001, [1.0] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = op1_hnsw(spark, str(tmp_path)).collect()
    good = [(i, v) for i, v in rows if v is not None and any(v)]
    hits = 0
    for q in [r for r in good if r[0] % 100 == 0]:
        wanted = brute(good, q, 10)
        mine = [(r["score"], r["vec_id"]) for r in sorted((r for r in out if r["query_id"] == q[0]), key=lambda r: r["rank"])]
        hits += len(set(mine) & set(wanted))
    assert len(out) == 100 and hits >= 95
