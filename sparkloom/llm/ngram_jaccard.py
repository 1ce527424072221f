"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Every document's set of hashed shingles is cut to its least ``n - t + s`` hashes, where t = ceil(0.8 n) is the overlap
   any partner must have and s = ceil(0.1 n). A linked pair shares at least s hashes inside both cuts, so a document with
   fewer cut hashes that occur elsewhere has no partner. (Hash blobs by block and range; see ``blocks``.)
2. Documents of equal sets become one row of the matrix. Among the rows left, hashes are counted again and each row
   keeps its ``m - t + 1`` rarest shared hashes, m being how many of its hashes are shared at all: a linked pair has one
   of these in common. Rows joined by such hashes form candidate components.
3. Inside a component the incidence matrix is multiplied with its transpose in column blocks, which accumulates the
   overlaps; row blocks whose sizes cannot reach the threshold are skipped. Large components are cut into tiles of sets
   of like size (a size band spans a factor of 1.26, more than a linked pair can differ by). Every tile is multiplied with
   itself and a few pivot rows of its band and the bands beside it. Pairs inside one linked group need no further test,
   since only connected groups are asked for; two sets that these products left in different groups can only be linked if
   they lie in the same or adjacent bands and share one of their rarest hashes, so the set of the smaller group visits the
   tiles of such partners, and no other. No pair is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ANSWER, BLOCK, HASHES, Blocks, answers, gathered, lookup, per_group, per_pair, to_buckets, told
from .common import BROADCAST_ROWS, checkpoint, fields, forget_shuffles, mix64, pack_sorted, read_table, refuse, shuffle_partitions, slices, text_buffer, unpack_sorted, word_hashes, word_spans
from .components import connected_components
from .substring_dedup import WINDOW_BASE, window_hashes

#: A to Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDS = 5
TILE, PIVOTS, COLUMNS, CHUNK = 160, 8, 4096, 128
#: Sizes of a linked pair differ by a factor of 1.25 at most, so they lie in the same or adjacent bands.
BAND = 1.26
#: Sets are stored by the upper 48 bits of their hashes: two of a pair's n shingles then meet by chance n*n / 2**48 times.
DROPPED = np.uint64(16)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, ascending within each row, and where each row starts (n+1 values)."""
    found, sizes = [], []
    for a, b in slices(offsets):
        part, local = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, local)
        words = word_hashes(part, starts, ends)
        hashes, at = window_hashes(words, first, WORDS)
        row = np.searchsorted(first, at, "right") - 1
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):  # the whole sequence as one shingle
            whole = np.empty(len(short), np.uint64)
            for k, i in enumerate(short):
                rolled = np.uint64(count[i])
                with np.errstate(over="ignore"):
                    for word in words[first[i] : first[i + 1]]:
                        rolled = rolled * WINDOW_BASE + word
                whole[k] = rolled
            hashes, row = np.concatenate([hashes, mix64(whole)]), np.concatenate([row, short])
        order = np.argsort(hashes)
        kind = np.int16 if b - a < 32768 else np.int64
        order = order[np.argsort(row[order].astype(kind), kind="stable")]
        hashes, row = hashes[order], row[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        found.append(hashes[fresh])
        sizes.append(np.bincount(row[fresh], minlength=b - a))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def needed(size: np.ndarray) -> np.ndarray:
    """The least overlap that a set of this size has with any partner: ceil(0.8 size)."""
    return (4 * size + 4) // 5


def inside_cut(first: np.ndarray) -> np.ndarray:
    """Which elements belong to their row's cut of least hashes."""
    size = np.diff(first)
    cut = size - needed(size) + (size + 9) // 10
    return np.arange(first[-1]) - np.repeat(first[:-1], size) < np.repeat(cut, size)


SETS = {"n_shingles": "long", "set_id": "long", "elements": "binary"}


def shingle_rows(df: DataFrame, text: str) -> DataFrame:
    """``df`` without its text, plus ``n_shingles``, ``set_id`` (a hash of the set; null if empty) and ``elements``: the set
    as a blob, in one row of each set and block, and only where the set may have a partner of another or the same set."""
    blocks = Blocks(df, text, df.columns[0])
    buckets, rest = blocks.buckets(0.05), [c for c in df.columns if c != text]

    def emit(table: pa.Table) -> pa.Table:
        hashes, first = shingle_sets(*text_buffer(table.column(text)))
        return to_buckets(table.column(BLOCK)[0].as_py(), np.unique(mix64(hashes[inside_cut(first)])), buckets)  # mixed: cuts crowd at the low end

    def meet(table: pa.Table) -> pa.Table:
        hashes, block, _, _ = gathered(table)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        return answers(block[order[twice]], hashes[order[twice]])

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        hashes, first = shingle_sets(*text_buffer(table.column(text)))
        size = np.diff(first)
        known, _ = told(answer)
        cut = np.flatnonzero(inside_cut(first))
        mixed = mix64(hashes[cut])
        own = np.sort(mixed)
        known = np.union1d(known, own[1:][own[1:] == own[:-1]])  # also those of two rows of this block
        shared, _ = lookup(mixed, known)
        row = np.repeat(np.arange(len(size)), size)
        hit = np.bincount(row[cut], weights=shared, minlength=len(size))
        total = np.concatenate([[0], np.cumsum(mix64(hashes))]).astype(np.uint64)
        ids = mix64((total[first[1:]] - total[first[:-1]]) * WINDOW_BASE + size.astype(np.uint64)).view(np.int64)
        alive = (size > 0) & (hit >= (size + 9) // 10)
        blobs, seen = [None] * len(size), set()
        for i in np.flatnonzero(alive).tolist():
            if ids[i] not in seen:
                seen.add(ids[i])
                blobs[i] = pack_sorted(hashes[first[i] : first[i + 1]] >> DROPPED)
        return pa.table([*[table.column(c) for c in rest], pa.array(size, pa.int64()), pa.array(ids, pa.int64(), mask=size == 0), pa.array(blobs, pa.binary())], names=[*rest, *SETS])

    met = per_group(blocks.emit(emit, HASHES), "bucket", meet, ANSWER, buckets)
    return blocks.answer(met, finish, T.StructType([*[df.schema[c] for c in rest], *fields(**SETS).fields]))


def candidate_edges(sets: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) between sets that have one of their rarest shared hashes in common, as stars around the least set; and
    these hashes: (set_id, hash), checkpointed."""
    spark = sets.sparkSession
    blocks = max(1, -(-count // 1000), min(-(-count // 50), 4 * shuffle_partitions(spark)))
    buckets = max(shuffle_partitions(spark), count // 4000)
    dealt = sets.withColumn(BLOCK, F.pmod("set_id", F.lit(blocks)).cast("int"))

    def read(table: pa.Table):
        column = table.column("elements")
        parts = [unpack_sorted(column[i].as_buffer()) for i in range(len(column))]
        return np.concatenate(parts) << DROPPED, np.array([len(p) for p in parts])

    def emit(table: pa.Table) -> pa.Table:
        hashes, n = np.unique(read(table)[0], return_counts=True)
        return to_buckets(table.column(BLOCK)[0].as_py(), hashes, buckets, counts=n.astype(np.uint32))

    def meet(table: pa.Table) -> pa.Table:
        hashes, block, order, _ = gathered(table)
        column = table.column("counts")
        n = np.concatenate([np.frombuffer(column[i].as_buffer(), np.uint32) for i in order])
        _, group = np.unique(hashes, return_inverse=True)
        total = np.bincount(group, weights=n)[group]
        kept = np.flatnonzero(total > 1)
        return answers(block[kept], hashes[kept], np.minimum(total[kept], 2**32 - 1).astype(np.uint32))

    def rarest(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"set_id": pa.array([], pa.int64()), "hash": pa.array([], pa.int64())})
        hashes, size = read(table)
        known, times = told(answer, np.uint32)
        shared, at = lookup(hashes, known)
        row = np.repeat(np.arange(len(size)), size)[shared]
        hashes, often = hashes[shared], times[at[shared]]
        order = np.lexsort((hashes, often, row))
        row, hashes = row[order], hashes[order]
        have = np.bincount(row, minlength=len(size))
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < (have - needed(size) + 1)[row]
        ids = table.column("set_id").to_numpy()
        return pa.table({"set_id": ids[row[kept]], "hash": hashes[kept].view(np.int64)})

    met = per_group(per_group(dealt, BLOCK, emit, HASHES + ", counts binary"), "bucket", meet, ANSWER, buckets)
    postings = checkpoint(per_pair(dealt, met, rarest, "set_id long, hash long"))
    stars = postings.groupBy("hash").agg(F.min("set_id").alias("v"))
    return postings.join(stars, "hash").where("set_id != v").select(F.col("set_id").alias("u"), "v").distinct(), postings


def overlaps(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Overlap counts of some sets with others: the incidence rows' product, in blocks of columns that both sides have."""
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    columns, column = np.unique(every, return_inverse=True)
    left, right = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    left[rows], right[others] = True, True
    used = (np.bincount(column, weights=left[owner], minlength=len(columns)) > 0) & (np.bincount(column, weights=right[owner], minlength=len(columns)) > 0)
    used &= np.bincount(column, minlength=len(columns)) > 1
    number = np.cumsum(used) - 1
    keep = used[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(rows), len(others)), np.float32)
    for start in range(0, int(used.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        out += block[rows] @ block[others].T
    return out


def linked_roots(sets: list[np.ndarray], near: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first set of its linked group. ``near``: only pairs with one of these rows count."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = order if near is None else order[np.isin(order, near)]
    for a in range(0, len(rows), 128):
        mine = rows[a : a + 128]
        low, high = size[mine[0]], size[mine[-1]]
        fits = order[(5 * size[order] >= 4 * low) & (4 * size[order] <= 5 * high)]  # the sizes' bound on the overlap
        if near is None:
            fits = fits[np.searchsorted(size[fits], low) :] if len(fits) else fits  # smaller ones had their turn
        both = overlaps([sets[i] for i in np.concatenate([mine, fits])], np.arange(len(mine)), np.arange(len(mine), len(mine) + len(fits)))
        i, j = np.nonzero(9 * both >= 4 * (size[mine][:, None] + size[fits][None]))
        for x, y in zip(mine[i].tolist(), fits[j].tolist(), strict=True):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    return np.array([find(x) for x in range(len(sets))])


LINKS = "u long, v long"


def _task(table: pa.Table, cross: bool) -> pa.Table:
    """Links that connect the members of each component in one task; ``cross``: rows with ``first`` against all."""
    component = table.column("component").to_numpy()
    ids, lead = table.column("set_id").to_numpy(), table.column("lead").to_numpy(zero_copy_only=False).astype(bool)
    column = table.column("elements")
    u, v = [], []
    order = np.lexsort((~lead, ids, component))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (component[order][1:] != component[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]  # a pivot may be a member of the tile too
    for part in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        if len(part) < 2:
            continue
        root = linked_roots([unpack_sorted(column[int(i)].as_buffer()) for i in part], np.flatnonzero(lead[part]) if cross else None)
        moved = np.flatnonzero(root != np.arange(len(part)))
        u.append(ids[part[moved]])
        v.append(ids[part[root[moved]]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"u": join(u), "v": join(v)})


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], spread: str, count: int, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with ``few`` (at most a row for each combination of keys, ``count`` in all): by broadcast within
    the bound of small sides, else with each key's rows dealt over ``salts`` parts by the column ``spread``."""
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), keys, "left")
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def link_sets(sets: DataFrame, members: DataFrame, postings: DataFrame) -> DataFrame:
    """Links (u, v) whose components are those of all linked pairs. ``members``: (v, label) of the candidate components;
    ``postings``: the hashes that made them. ``sets`` has set_id, size and elements."""
    parts = shuffle_partitions(sets.sparkSession)
    members = members.select(F.col("v").alias("set_id"), F.col("label").alias("component"))
    band = F.floor(F.log("size") / F.log(F.lit(BAND))).cast("int")
    placed = checkpoint(members.join(sets.select("set_id", band.alias("band")), "set_id"))
    sizes = placed.groupBy("component").count().where(F.col("count") > TILE).select("component")
    tiles = placed.groupBy("component", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = checkpoint(tiles.join(sizes, "component", "left_semi"))  # of large components
    placed = spread_join(placed, tiles, ["component", "band"], "set_id", tiles.count())
    placed = checkpoint(placed.withColumn("tile", F.pmod(F.xxhash64("set_id"), "tiles").cast("int")))
    small, large = placed.where("tiles IS NULL"), placed.where("tiles IS NOT NULL")
    columns = ["task", "component", "set_id", "lead"]

    def work(rows: DataFrame, cross: bool) -> DataFrame:
        return checkpoint(per_group(sets.select("set_id", "elements").join(rows.select(columns), "set_id"), "task", lambda t: _task(t, cross), LINKS))

    alone = F.pmod(F.xxhash64("component"), F.lit(8 * parts))  # small components share tasks
    tiled = F.xxhash64("component", "band", "tile")
    own = small.withColumn("task", alone).union(large.withColumn("task", tiled)).withColumn("lead", F.lit(False))
    pivots = large.where(F.col("tile") < PIVOTS).groupBy("component", "band", "tile").agg(F.min("set_id").alias("set_id"))
    reach = pivots.select("component", "set_id", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    shown = reach.join(tiles, ["component", "band"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    links = work(own.select(columns).union(shown.withColumn("task", tiled).withColumn("lead", F.lit(True)).select(columns)), False)
    if tiles.isEmpty():
        return links
    groups = connected_components(links).select(F.col("v").alias("set_id"), "label")
    held = large.join(groups, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    held = checkpoint(held.select("set_id", "component", "band", "tile", "label"))
    count = held.groupBy("label").agg(F.count("*").alias("members"))
    held = checkpoint(spread_join(held, count, ["label"], "set_id", count.count()))
    split = held.groupBy("component").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("component")
    open_ = checkpoint(held.join(split, "component", "left_semi").join(postings, "set_id"))  # components of several groups
    if open_.isEmpty():
        return links
    group = F.struct("members", "label")
    homes = open_.groupBy("hash", "component", "band", "tile").agg(F.max(group).alias("most"))  # a row a tile, however common the hash
    guests = open_.select("hash", "set_id", F.col("label").alias("own"), F.col("members").alias("few"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    larger = F.struct(F.col("few").alias("members"), F.col("own").alias("label")) < F.col("most")  # a larger group's set is there
    visits = checkpoint(guests.join(homes, ["hash", "band"]).where(larger).select("set_id", "component", "band", "tile").distinct())
    chunks = checkpoint(visits.groupBy("component", "band", "tile").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    many, place = chunks.count(), ["component", "band", "tile"]
    asked = spread_join(visits, chunks, place, "set_id", many).withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(3)), "chunks").cast("int")).withColumn("lead", F.lit(True))
    shown = spread_join(held, chunks, place, "set_id", many).where("chunks IS NOT NULL")
    shown = shown.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("lead", F.lit(False))
    cross = [df.withColumn("task", F.xxhash64(*place, "chunk")).select(columns) for df in (asked, shown)]
    return links.union(work(cross[0].union(cross[1]), True))


def jaccard_components(df: DataFrame, key: str, text: str, label: str | None = None) -> DataFrame:
    """``df`` without its text, plus ``n_shingles``, ``set_id`` and ``component_id``: the least key that links reach.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z lower-cased; a set holds the distinct runs of five words, or
    the whole sequence if it is shorter. Rows link when 100 * overlap >= 80 * union. A null or empty text has an empty set,
    a null ``set_id``, links with nothing and is its own component. Rows of equal keys are told apart by their sets. A null
    key is never the least; a component of null keys only has a null id. ``key`` is a long column. Components of repeated
    keys may have equal ids; ``label`` names a column for the component's least set_id, which no other has (null for an
    empty set).
    """
    refuse(df, [*SETS, "component_id", *([label] if label else [])])
    others, given = [c for c in df.columns if c not in (key, text)], (key, text)
    df = df.select(key, text, *others).toDF("key", "text", *[f"column_{k}" for k in range(len(others))])
    key, text = "key", "text"
    rows = checkpoint(shingle_rows(df, text))
    forget_shuffles(df.sparkSession)  # the texts
    sets = checkpoint(rows.where("elements is not null").groupBy("set_id").agg(F.first("n_shingles").alias("size"), F.first("elements").alias("elements")))
    edges, postings = candidate_edges(sets, sets.count())
    candidates = connected_components(edges)
    forget_shuffles(df.sparkSession)  # the sets' hashes
    labels = checkpoint(connected_components(link_sets(sets, candidates, postings)))
    least = rows.where("set_id is not null").groupBy("set_id").agg(F.min(key).alias("least"), F.count("*").alias("times"))
    linked = checkpoint(least.join(labels.withColumnRenamed("v", "set_id"), "set_id"))  # sets with a partner
    roots = checkpoint(linked.groupBy("label").agg(F.min("least").alias("component_id")))
    linked = spread_join(linked, roots, ["label"], "set_id", roots.count()).select("set_id", "component_id", "label")
    copies = least.where("times > 1").join(linked, "set_id", "left_anti").select("set_id", F.col("least").alias("component_id"), F.col("set_id").alias("label"))
    found = checkpoint(linked.union(copies))  # sets of several rows; copies without number may share one
    out = spread_join(rows.drop("elements"), found.withColumn("met", F.lit(True)), ["set_id"], key, found.count())
    out = out.withColumn("component_id", F.when(F.col("met"), F.col("component_id")).otherwise(F.col(key)))
    more = [F.coalesce("label", "set_id").alias(label)] if label else []
    kept = [F.col(f"column_{k}").alias(c) for k, c in enumerate(others)]
    return out.select(F.col(key).alias(given[0]), *kept, "n_shingles", "set_id", "component_id", *more)


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document with its set's size and its component."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, "doc_id", "text").select("doc_id", "n_shingles", "component_id")


#: The same in SQL: overlaps of all pairs with a common shingle, then everything that links reach.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
