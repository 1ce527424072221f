"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. Token counts are summed by source and hash bucket; a source's budget falls into one
bucket, and only that bucket is summed again by the next bits of the hash, until the threshold is known to the
document. The rows are then filtered by comparing their hash with their source's threshold: nothing is sorted, and a
smaller budget always takes a subset of what a larger one takes.

Memory: the driver holds a few numbers for each source (a mix states a weight for each, so they are few next to rows). Sums are taken by (source, bucket) with partial aggregation,
so a source with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, read_table, refuse, small_side

#: What separates words: [^\x20\x09-\x0D]+ matches one.
WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12


def row_hash(column: Column, seed: str = "") -> Column:
    """60 bits of the MD5 of a value's text, as a long; null counts as empty text."""
    text = F.concat(F.lit(seed), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def water_fill(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int], share: tuple[int, int], cap: int) -> dict:
    """Target of each source: weights repeat over the sources by code point, null last; they share share[0]/share[1] of
    all sizes; a target stops at cap times its source's size and the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    left = [(cap * size, weights[k % len(weights)], name) for k, (name, size) in enumerate(order)]
    left.sort(key=lambda x: (x[0] / x[1], x[1], x[2] is None, (x[2] or "").encode()))
    budget, weight, used, out = sum(s for _, s in sizes) * share[0] / share[1], sum(x[1] for x in left), 0, {}
    for top, own, name in left:
        level = (budget - used) / weight
        if top <= level * own:
            out[name] = float(top)
            used, weight = used + top, weight - own
        else:
            out[name] = level * own
    return out


def plan_mix(df: DataFrame, source: str, size: str, hash_column: str, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, tie: str | None = None) -> DataFrame:
    """A row for each source: ``__source``, ``source_size``, ``target``, ``__whole`` (times that every row is taken) and
    ``__limit`` (rows with a smaller hash are taken once more: the prefix in hash order whose sum is nearest to the rest).

    ``hash_column`` holds 60-bit hashes; rows of equal source and hash stand or fall together. ``tie`` names a second such
    column that orders rows of equal hash: where they are several on the boundary, ``__tie_limit`` cuts them, and only
    rows equal in both stand or fall together. A null source is a source;
    sizes must not be null; a source without any words has target 0. ``df`` is read once for each level of the refinement
    (two or three, of narrow columns), so pass a checkpoint if its columns are costly.
    """
    spark = df.sparkSession
    sizes = {r[0]: int(r[1]) for r in df.groupBy(F.col(source)).agg(F.sum(size)).collect()}
    targets = water_fill(list(sizes.items()), weights, share, cap)
    whole = {s: int(t // sizes[s]) if sizes[s] else 0 for s, t in targets.items()}
    rest = {s: targets[s] - whole[s] * sizes[s] for s in sizes}
    hashes = [hash_column, *([tie] if tie else [])]
    limits = [{s: 0 for s in sizes} for _ in range(2)]  # rows with a hash below it are taken once more
    below = {s: 0 for s in sizes}  # words of the rows below it
    open_ = {s for s in sizes if rest[s] > 0 and sizes[s]}
    kind = T.StructType([T.StructField("__source", df.schema[source].dataType), T.StructField("__edge", T.LongType()), T.StructField("__prefix", T.LongType()), T.StructField("__room", T.DoubleType())])
    for turn, level in [(t, x) for t in range(len(hashes)) for x in range(0, BITS, STEP)]:
        if not open_:
            break
        limit, shift = limits[turn], BITS - level - STEP
        state = spark.createDataFrame([(s, limits[0][s], limit[s] >> (shift + STEP), float(rest[s] - below[s])) for s in open_], kind)
        rows = df.select(F.col(source).alias("__s"), F.col(hash_column).alias("__first"), F.shiftright(hashes[turn], shift).alias("__bucket"), F.col(size).alias("__size"))
        inside = F.col("__s").eqNullSafe(F.col("__source")) & (F.shiftright("__bucket", STEP) == F.col("__prefix"))
        if turn:  # only rows of the boundary's hash
            inside &= F.col("__first") == F.col("__edge")
        sums = rows.join(small_side(state, len(open_)), inside).groupBy("__s", "__bucket", "__room").agg(F.sum("__size").alias("__sum"), F.count("*").alias("__rows"))
        reach = F.sum("__sum").over(Window.partitionBy("__s").orderBy("__bucket"))  # 2**STEP buckets a source at most
        over = sums.withColumn("__reach", reach).where(F.col("__reach") > F.col("__room"))
        edge = F.min_by(F.struct("__bucket", "__sum", "__rows", "__reach"), "__bucket")
        for s, (bucket, total, n, reached) in over.groupBy("__s").agg(edge).collect():  # a row a source
            below[s] += reached - total
            limit[s] = bucket << shift
            if n == 1 or (shift == 0 and turn == len(hashes) - 1):  # one document, or documents of one hash: take it if that comes nearer
                if below[s] + total / 2 <= rest[s]:
                    below[s] += total
                    limit[s] = (bucket + 1) << shift
                open_.discard(s)
    kind = T.StructType([T.StructField("__source", df.schema[source].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("__whole", T.IntegerType()), T.StructField("__limit", T.LongType()), T.StructField("__tie_limit", T.LongType())])
    return small_side(spark.createDataFrame([(s, sizes[s], targets[s], whole[s], limits[0][s], limits[1][s]) for s in sizes], kind), len(sizes))


def apply_mix(df: DataFrame, plan: DataFrame, source: str, hash_column: str, tie: str | None = None) -> DataFrame:
    """``df`` with ``source_size`` (long), ``target`` (double) and ``times`` (int): how often the mix takes each row.

    Columns of these names raise ValueError, others may have any name; an empty table gives no rows; a row is taken 0 times
    if its source has no words. ``tie`` is the column that the plan was made with.
    """
    refuse(df, ["source_size", "target", "times"])
    given, names = df.columns, [f"column_{k}" for k in range(len(df.columns))]
    source, hash_column, tie = (c and names[given.index(c)] for c in (source, hash_column, tie))
    df = df.toDF(*names)
    again = F.col(hash_column) < F.col("__limit")
    if tie:
        again |= (F.col(hash_column) == F.col("__limit")) & (F.col(tie) < F.col("__tie_limit"))
    times = F.col("__whole") + again.cast("int")
    out = df.join(plan, F.col(source).eqNullSafe(F.col("__source"))).withColumn("times", F.when(F.col("source_size") > 0, times).otherwise(0))
    return out.select(*names, "source_size", "target", "times").toDF(*given, "source_size", "target", "times")


def word_count(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def op5_hash_threshold_mix(spark, sf_dir: str) -> DataFrame:
    """All documents: the words that the mix takes of each, repeats counted."""
    docs = read_table(spark, sf_dir, "documents")
    rows = checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("hash")))
    out = apply_mix(rows, plan_mix(rows, "source", "size", "hash"), "source", "hash")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "source")


#: The same rule in SQL: a prefix in hash order within each source, and targets by a running sum over capacity / weight.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS top, row_number() OVER (ORDER BY 2 * source_size / w, w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 3 / 2 - coalesce(sum(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT min(k) AS k FROM l WHERE top > level * w),
t AS (SELECT l.source, l.source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN l.top::DOUBLE ELSE (SELECT x.level FROM l AS x WHERE x.k = f.k) * l.w END AS target FROM l, f),
g AS (SELECT source, hash, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) - sum(size) AS before FROM d GROUP BY source, hash)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)
         + CASE WHEN g.before + g.own / 2 <= t.target - floor(t.target / t.source_size) * t.source_size AND t.target > floor(t.target / t.source_size) * t.source_size THEN 1 ELSE 0 END END)::BIGINT AS taken,
       (CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)
         + CASE WHEN g.before + g.own / 2 <= t.target - floor(t.target / t.source_size) * t.source_size AND t.target > floor(t.target / t.source_size) * t.source_size THEN 1 ELSE 0 END END)::INTEGER AS times,
       d.source
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.hash = g.hash
"""
