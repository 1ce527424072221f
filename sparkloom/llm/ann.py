"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one node that keeps the ids nearest results can need (k + 1 least): they meet in a grouped limit before
anything else, so a vector that a third of all rows share costs one node. Nodes go to cells, the nearest of some centres
that are fitted on a bounded sample; a cell of more than ``shard_rows`` nodes is cut into shards by a hash, so near copies
without number fill shards and no task. Each shard builds its own graph and stores it as flat arrays in one row: vectors,
ids, and for each layer the member numbers and a members x degree neighbour array.

A query is sent to the shards of its nearest cells, a few hundred bytes each; no shard travels but to the blocks of
``block`` queries that search it. How many cells that are is measured: exact neighbours of a sample of the index's own
vectors, found in one scan, tell how many cells hold the share ``target`` of them. Vectors without any structure are
then searched in all cells. The best k of all shards are kept.

A layer's neighbours are chosen from the exact nearest candidates inside the shard by the graph's diversity rule (a
candidate is kept if it is nearer to the node than to every neighbour kept before), made symmetric and cut to the
degree. Layers are nested: a node's top layer falls off geometrically by a hash of its id. Search starts from the
whole top layer, whose size is bounded by the shard's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_number
from .common import checkpoint, mix64, read_table, shuffle_partitions, small_side


@dataclass(frozen=True)
class Params:
    shard_rows: int = 4096
    degree: int = 16  # twice that on the lowest layer
    candidates: int = 64
    fan: int = 16  # a layer has about 1/fan of the nodes of the one below
    beam: int = 96
    block: int = 2048  # queries of a shard that one task searches
    cells: int = 1024  # at most
    sample: int = 32768  # nodes to fit the centres on, at most
    asked: int = 256  # nodes whose exact neighbours are looked for to measure how many cells to search
    target: float = 0.96  # of these neighbours, the share that the searched cells must hold


@dataclass(frozen=True)
class Index:
    """``shards``: a row of flat arrays each (schema INDEX). ``first``: each cell's first shard number, and the number of
    shards. ``probes``: how many of a query's nearest cells are searched."""

    shards: DataFrame
    dims: int
    centres: np.ndarray
    first: np.ndarray
    probes: int


INDEX = "shard int, vectors binary, ids binary, layers array<struct<members:binary,neighbours:binary>>"
#: Beyond these magnitudes squares of doubles overflow or vanish; such shards are computed in a wider type.
LARGE, SMALL = 1e100, 1e-100
NO_ID = np.iinfo(np.int64).max


def centred(*sets: np.ndarray) -> list[np.ndarray]:
    """The sets less the first one's mean, which keeps digits where points lie far from the origin; in a wider type if
    their squares would leave the range of doubles."""
    size = [np.abs(x) for x in sets if x.size]
    most = max((float(x.max()) for x in size), default=0.0)
    least = min((float(x[x > 0].min()) for x in size if (x > 0).any()), default=1.0)
    if most > LARGE or least < SMALL:
        sets = tuple(x.astype(np.longdouble) for x in sets)
    middle = sets[0].mean(0) if len(sets[0]) else 0
    return [x - middle for x in sets]


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows that belong together (the last axis), in doubles; wider where squares need it."""
    gap = b - a
    size = np.abs(gap)
    if size.size and (not np.isfinite(size).all() or size.max() > LARGE or ((size > 0) & (size < SMALL)).any()):
        gap = b.astype(np.longdouble) - a.astype(np.longdouble)
    return np.sqrt((gap * gap).sum(-1)).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b (a block of queries against a bounded shard)."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def link_layer(vectors: np.ndarray, degree: int, candidates: int) -> np.ndarray:
    """Neighbour array (n x degree, -1 for none) of one layer."""
    n = len(vectors)
    out = np.full((n, degree), -1, np.int32)
    if n < 2:
        return out
    wide = min(candidates, n - 1)
    chosen: list[np.ndarray] = []
    for a in range(0, n, 256):
        part = vectors[a : a + 256]
        far = distances(part, vectors)
        far[np.arange(len(part)), np.arange(a, a + len(part))] = np.inf
        near = np.argpartition(far, wide - 1, axis=1)[:, :wide]
        own = np.take_along_axis(far, near, 1)
        order = np.lexsort((near, own))
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        between = vectors[near]
        norm = (between * between).sum(2)
        apart = norm[:, :, None] + norm[:, None, :] - 2 * (between @ between.transpose(0, 2, 1))
        kept = np.zeros(near.shape, bool)
        for c in range(wide):
            blocked = (kept & (apart[:, c, :] < own[:, c, None])).any(1)
            kept[:, c] = ~blocked & (kept.sum(1) < degree // 2)
        kept[:, : min(4, wide)] = True  # the very nearest stay, so that dense spots hold together
        row, col = np.nonzero(kept)
        chosen.append(np.column_stack([row + a, near[row, col], own[row, col]]))
    pairs = np.concatenate(chosen)
    both = np.concatenate([pairs, pairs[:, [1, 0, 2]]])
    both = both[np.lexsort((both[:, 1], both[:, 2], both[:, 0]))]
    source, target = both[:, 0].astype(np.int64), both[:, 1].astype(np.int32)
    fresh = np.ones(len(both), bool)
    fresh[1:] = (source[1:] != source[:-1]) | (target[1:] != target[:-1])
    source, target = source[fresh], target[fresh]
    rank = np.arange(len(source)) - np.searchsorted(source, source)
    ok = rank < degree
    out[source[ok], rank[ok]] = target[ok]
    return out


def build_index(nodes: np.ndarray, table: np.ndarray, params: Params) -> dict:
    """Flat arrays of one shard: distinct vectors, their least ids (rest: NO_ID), and the layers."""
    vectors, (nodes,) = nodes, centred(nodes)
    height = np.zeros(len(nodes), int)
    draw = mix64(table[:, 0].astype(np.uint64)).astype(float) / 2.0**64
    top = 0
    while len(nodes) / params.fan ** (top + 1) >= params.fan / 2:
        top += 1
        height += draw < params.fan**-top
    layers = []
    for level in range(top + 1):
        members = np.flatnonzero(height >= level)
        if level and not len(members):
            break
        layers.append((members.astype(np.int32), link_layer(nodes[members], params.degree * (2 if level == 0 else 1), params.candidates)))
    return {"vectors": vectors, "ids": table, "layers": layers}


def search_layer(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of a block of queries over one layer; entry: queries x some node numbers (-1 for none)."""
    rows, n = len(queries), len(vectors)
    norm, own = (vectors * vectors).sum(1), (queries * queries).sum(1)
    seen = np.zeros((rows, n + 1), bool)

    def far(nodes: np.ndarray, who: np.ndarray) -> np.ndarray:
        d = norm[nodes] + own[who, None] - 2 * np.einsum("ijk,ik->ij", vectors[nodes], queries[who])
        return np.where(nodes < 0, np.inf, d)

    every = np.arange(rows)
    near = entry
    dist = far(near, every)
    seen[every[:, None], near] = True
    done = near < 0
    active = every
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        pick = open_.argmin(1)
        go = open_[np.arange(len(active)), pick] < np.inf
        active, pick = active[go], pick[go]
        if not len(active):
            break
        node = near[active, pick]
        done[active, pick] = True
        new = neighbours[node]
        new = np.where(seen[active[:, None], new], -1, new)
        seen[active[:, None], new] = True
        seen[:, n] = False
        d = far(new, active)
        wide_n, wide_d = np.concatenate([near[active], new], 1), np.concatenate([dist[active], d], 1)
        wide_o = np.concatenate([done[active], new < 0], 1)
        size = min(beam, wide_n.shape[1])
        order = np.argsort(wide_d, axis=1, kind="stable")[:, :size]
        if near.shape[1] < size:
            grow = size - near.shape[1]
            near = np.concatenate([near, np.full((rows, grow), -1, near.dtype)], 1)
            dist = np.concatenate([dist, np.full((rows, grow), np.inf)], 1)
            done = np.concatenate([done, np.ones((rows, grow), bool)], 1)
        near[active, :size] = np.take_along_axis(wide_n, order, 1)
        dist[active, :size] = np.take_along_axis(wide_d, order, 1)
        done[active, :size] = np.take_along_axis(wide_o, order, 1)
        done[active, size:] = True
        dist[active, size:] = np.inf
        near[active, size:] = -1
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)


def search_index(index: dict, queries: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers found for each query (queries x beam at most, -1 for none), from the top layer down."""
    vectors, layers = index["vectors"], index["layers"]
    entry = np.tile(layers[-1][0], (len(queries), 1))
    for level in range(len(layers) - 1, -1, -1):
        members, neighbours = layers[level]
        place = np.full(len(vectors) + 1, -1, np.int32)
        place[members] = np.arange(len(members))
        found, _ = search_layer(vectors[members], neighbours, queries, place[entry], beam if level == 0 else max(16, beam // 3))
        entry = np.where(found < 0, -1, members[found])
    return entry


def usable(column: str):
    """Not null, not empty, no null or non-finite component, not all zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), np.float64)


def fit_centres(points: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of about even cells by Lloyd's rounds, from points spread over the sample; a cell that empties starts anew."""
    if cells < 2 or len(points) <= cells:
        return points[:1] if cells < 2 else points
    centres = points[:: len(points) // cells][:cells].copy()
    for _ in range(rounds):
        near = nearest_cells(points, centres, 1)[:, 0]
        count = np.bincount(near, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], points[mix64(np.arange(cells, dtype=np.uint64)) % np.uint64(len(points))])
    return centres


def nearest_cells(points: np.ndarray, centres: np.ndarray, many: int) -> np.ndarray:
    """The numbers of the ``many`` nearest centres of each point, nearest first."""
    out = np.zeros((len(points), many), np.int64)
    base, points = centred(centres, points)
    for a in range(0, len(points), 1024):
        far = distances(points[a : a + 1024], base)
        if many < far.shape[1]:
            some = np.argpartition(far, many - 1, axis=1)[:, :many]
            out[a : a + 1024] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
        else:
            out[a : a + 1024] = np.argsort(far, axis=1, kind="stable")
    return out


def nodes_of(rows: DataFrame, key: str, vector: str, keep: int) -> tuple[DataFrame, int, int]:
    """(vector, ids) for each distinct vector of the most frequent dimension, with its ``keep`` least ids, checkpointed; the
    dimension; how many nodes there are."""
    good = rows.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sizes = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    dims = sizes[0]["d"] if sizes else 1
    # an equal node for -0.0 and 0.0; each task keeps its least ids before the exchange
    same = good.where(F.size("vector") == dims).select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).distinct()
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = same.withColumn("rank", rank).where(F.col("rank") <= keep)
    nodes = checkpoint(least.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # keep ids at most
    return nodes, dims, nodes.count()


def measure_probes(nodes: DataFrame, centres: np.ndarray, dims: int, k: int, params: Params) -> int:
    """How many nearest cells hold ``target`` of the exact k nearest other nodes of a sample: one scan of the nodes."""
    spark = nodes.sparkSession
    order = F.xxhash64("vector", F.lit(7))
    said = nodes.select("vector").orderBy(order, "vector").limit(params.asked).collect()
    asked = np.array([r["vector"] for r in said], np.float64)
    held = spark.sparkContext.broadcast((asked, centres))

    def run(batches):
        asked, centres = held.value
        for batch in batches:
            points = matrix(batch.column(0), dims)
            if not len(points):
                continue
            cell = nearest_cells(points, centres, 1)[:, 0]
            base, mine = centred(asked, points)
            far = distances(base, mine)
            far[(far <= 0) | (asked[:, None, 0] == points[None, :, 0]) & (asked[:, None, -1] == points[None, :, -1])] = np.inf  # itself
            wide = min(k, far.shape[1])
            near = np.argpartition(far, wide - 1, axis=1)[:, :wide]
            own = np.take_along_axis(far, near, 1).astype(np.float64)
            who = np.repeat(np.arange(len(asked)), wide)
            fine = np.isfinite(own.ravel())
            yield pa.RecordBatch.from_pydict({"who": who[fine], "cell": cell[near].ravel()[fine], "far": own.ravel()[fine]})

    near = nodes.select("vector").mapInArrow(run, "who long, cell long, far double")
    rank = F.row_number().over(Window.partitionBy("who").orderBy("far", "cell"))
    found = near.withColumn("rank", rank).where(F.col("rank") <= k).select("who", "cell").collect()  # asked * k rows
    order = nearest_cells(asked, centres, len(centres))
    place = np.argsort(order, axis=1)
    needed = np.sort([place[r["who"], r["cell"]] + 1 for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(params.target * len(needed))))]) if len(needed) else len(centres)


def build_shards(rows: DataFrame, key: str, vector: str, k: int, params: Params = Params()) -> Index:
    """The index of all rows, in the checkpoint folder.

    Rows with an unusable vector or a null id are left out, as are vectors that have not the most frequent dimension
    (of equally frequent ones the smaller). Repeated rows count once; an id with several vectors stands in a node for each.
    """
    spark = rows.sparkSession
    nodes, dims, count = nodes_of(rows, key, vector, k + 1)
    cells = max(1, min(params.cells, -(-count // params.shard_rows)))
    if cells > 1:
        fitted = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(min(params.sample, 64 * cells)).collect()
        centres = fit_centres(np.array([r["vector"] for r in fitted], np.float64), cells)
    else:
        centres = np.zeros((1, dims))
    cells = len(centres)
    probes = measure_probes(nodes, centres, dims, k, params) if cells > 4 else cells
    held = spark.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            cell = nearest_cells(matrix(batch.column(0), dims), held.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vector", "ids", "cell"])

    placed = nodes.select("vector", "ids").mapInArrow(place, "vector array<double>, ids array<long>, cell int")
    placed = checkpoint(placed) if cells > 1 else placed
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    parts = [-(-sizes.get(c, 0) // params.shard_rows) for c in range(cells)]
    first = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
    numbers = F.array(*[F.lit(int(x)) for x in first])
    at = F.get(numbers, F.col("cell"))
    shard = at + F.pmod(F.xxhash64("vector"), F.greatest(F.get(numbers, F.col("cell") + 1) - at, F.lit(1)))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        least = np.full((len(ids), k + 1), NO_ID)
        for i, own in enumerate(ids):
            least[i, : len(own)] = own
        order = np.argsort(least[:, 0], kind="stable")
        made = build_index(matrix(table.column("vector"), dims)[order], least[order], params)
        layers = [{"members": m.tobytes(), "neighbours": x.tobytes()} for m, x in made["layers"]]
        row = {"shard": [table.column("shard")[0].as_py()], "vectors": [made["vectors"].tobytes()], "ids": [made["ids"].tobytes()], "layers": [layers]}
        kinds = pa.schema([("shard", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("layers", pa.list_(pa.struct([("members", pa.binary()), ("neighbours", pa.binary())])))])
        return pa.table(row, schema=kinds)

    dealt = by_number(placed.select("vector", "ids", shard.cast("int").alias("shard")), "shard", max(1, int(first[-1])))
    return Index(checkpoint(dealt.groupBy("shard").applyInArrow(run, INDEX)), dims, centres, first, probes)


def search_shards(index: Index, queries: DataFrame, key: str, vector: str, k: int, params: Params = Params()) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean distance in doubles).

    A query's own id is never among them; ties go to the smaller id. Queries with an unusable vector, or one of another
    dimension than the index, give no rows; fewer than k candidates give as many rows. A query id that stands in several
    rows counts once for each distinct vector and its best k rows are given.
    """
    spark, dims, probes = queries.sparkSession, index.dims, index.probes
    good = queries.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    held = spark.sparkContext.broadcast((index.centres, index.first))

    def route(batches):
        centres, first = held.value
        for batch in batches:
            near = nearest_cells(matrix(batch.column(1), dims), centres, probes)
            parts = first[near + 1] - first[near]
            who = np.repeat(np.repeat(np.arange(len(near)), probes), parts.ravel())
            count = parts.ravel()
            shard = np.repeat(first[near].ravel(), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            for a in range(0, max(1, len(who)), 10_000):  # a query's vector stands once for each of its shards
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(who[a : a + 10_000])) for c in batch.columns], pa.array(shard[a : a + 10_000].astype(np.int32))], names=["query_id", "vector", "shard"])

    asked = good.where(F.size("vector") == dims).distinct().mapInArrow(route, "query_id long, vector array<double>, shard int")
    asked = checkpoint(asked)
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / params.block).cast("int").alias("blocks"))
    asked = asked.join(small_side(blocks, int(index.first[-1])), "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
    shown = index.shards.join(small_side(blocks, int(index.first[-1])), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asked.num_rows or not shard.num_rows:
            return empty
        vectors = np.frombuffer(shard.column("vectors")[0].as_buffer(), np.float64).reshape(-1, dims)
        ids = np.frombuffer(shard.column("ids")[0].as_buffer(), np.int64).reshape(len(vectors), -1)
        layers = []
        for layer in shard.column("layers")[0]:
            members = np.frombuffer(layer["members"].as_buffer(), np.int32)
            layers.append((members, np.frombuffer(layer["neighbours"].as_buffer(), np.int32).reshape(len(members), -1)))
        every, everyone = matrix(asked.column("vector"), dims), asked.column("query_id").to_numpy()
        out = []
        for a in range(0, len(every), 256):
            wanted, own = every[a : a + 256], everyone[a : a + 256]
            near, mine = centred(vectors, wanted)
            found = search_index({"vectors": near, "layers": layers}, mine, params.beam)[:, : 2 * k + 8]
            score = exact_distances(wanted[:, None, :], vectors[found])
            hits = np.where(found[:, :, None] < 0, NO_ID, ids[found])
            score = np.repeat(score, ids.shape[1], axis=1)
            hits = hits.reshape(len(wanted), -1)
            none = (hits == own[:, None]) | (hits == NO_ID)
            order = np.lexsort((hits, score, none))
            score, hits, none = (np.take_along_axis(x, order, 1) for x in (score, hits, none))
            none[:, 1:] |= (hits[:, 1:] == hits[:, :-1]) & (score[:, 1:] == score[:, :-1])  # an id's vectors at one distance
            order = np.argsort(none, axis=1, kind="stable")[:, :k]
            score, hits, none = (np.take_along_axis(x, order, 1) for x in (score, hits, none))
            who, at = np.nonzero(~none)
            out.append(pa.table({"query_id": own[who], "vec_id": hits[who, at], "score": score[who, at]}))
        return pa.concat_tables(out) if out else empty

    tasks = max(1, min(int(index.first[-1]), 16 * shuffle_partitions(spark)))
    shown, asked = (df.repartition(tasks, "shard", "block") for df in (shown, asked))
    best = shown.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_hnsw(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every embedding whose id is divisible by 100, among all others."""
    rows = read_table(spark, sf_dir, "embeddings")
    index = build_shards(rows, "vec_id", "embedding", 10)
    return search_shards(index, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)
